"""Helpers on Arrow text batches: pieces of bounded bytes, words, folds of row keys."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int = 5) -> Column:
    """``crc32`` of the key as text modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` do not have, in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give freed memory of this process back to the system; a reused Python worker keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def spans(texts: pa.Array, most: int = 4_000_000, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most ``rows`` texts and ``most`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield at, to
        at = to


def pieces(texts: pa.Array, most: int = 4_000_000, rows: int = 1 << 16) -> Iterator[pa.Array]:
    """The texts (null: empty) in runs of bounded size."""
    for at, to in spans(texts, most, rows):
        # A copy that starts at its own buffers' beginning: the split kernel misreads slices.
        piece = texts.slice(at, to - at).cast(pa.large_string())
        yield pc.fill_null(piece, "").take(pa.array(np.arange(to - at)))


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of one of the ``pieces`` in an array, and the offsets of the texts in it."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, starts, data = texts.buffers()
    offsets = np.frombuffer(starts, np.int64, len(texts) + 1)
    flat = np.frombuffer(data, np.uint8, offsets[-1]) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of one of the ``pieces``, ASCII letters lower-cased, and the text number of each word."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(filled), owner[filled.to_numpy(zero_copy_only=False)]
