"""Alignment of two tokenizers' tokens by byte offsets.

Each text is encoded by a byte-level BPE (A) and by a SentencePiece BPE (B). The cumulative ends of both token lists are
keys of an end-to-index dictionary; the intersection of the two key sets, sorted, slices both id lists into groups. Within
a slice, each run of bytes between neighbouring ends of either list lies in one token of A and one of B: a link.

How many documents hold a pair of ids linked is counted over all documents. Documents go in blocks of ``BLOCK_BYTES`` of
text as they come; a block's pairs are counted within it first, and a block asks for the counts of its own pairs only, so
neither the documents nor the table of pairs meet in one task or on the driver. The one table that is joined with all pairs,
the highest count of each id of A, has at most as many rows as A has ids.

Null and empty texts, and texts that a tokenizer does not give back byte for byte (such as texts with U+2581), have no
tokens. Each row is a document: repeated rows count, null and repeated keys too, and each row gets its own result. An empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.texts import spans
from tessera.session import cut_lineage, spread

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE_BYTES = 1_000_000
BLOCK_BYTES = 1 << 24
# Fixed value: how a byte-level vocabulary splits a text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A pair of ids is one int: A's id in the upper, B's in the lower 16 bits, less 2^31.
SHIFT, LEAST = 16, -(1 << 31)


def byte_letters() -> dict[str, int]:
    """The letters in which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others
    follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece: ``<0xHH>`` is a byte, U+2581 a blank."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Both tokenizers, and the bytes of their tokens. A's merges go by the order of its ids."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        whole = Tokenizer.from_str(a.decode())
        self.b = SentencePieceProcessor(model_proto=b)
        letters, vocabulary = byte_letters(), whole.get_vocab(with_added_tokens=False)
        special = whole.get_added_tokens_decoder()
        self.a_bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            if i not in special:
                self.a_bytes[i] = bytes(letters[c] for c in token)
        ranks = {token: i for i, token in enumerate(self.a_bytes) if token}
        self.a = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.a_table, self.b_table = Table(self.a_bytes), Table(self.b_bytes)

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each text; none if the tokens do not give back its bytes."""
        one, other = [self.a.encode_ordinary(" " + t) if t else [] for t in texts], self.b.encode(texts, num_threads=1)
        whole = [(" " + t).encode() if t else b"" for t in texts]
        for i in np.flatnonzero(~(self.a_table.spells(one, whole) & self.b_table.spells(other, whole))):
            one[i] = other[i] = []
        return one, other


class Table:
    """Tokens' sizes, and their ids as text before each mark of the written form."""

    MARKS = [",", "|", ";", ""]

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.tokens = pa.array(tokens, pa.large_binary())
        self.texts = pa.array([f"{i}{mark}" for mark in self.MARKS for i in range(len(tokens))], pa.large_string())

    def spells(self, ids: list[list[int]], texts: list[bytes]) -> np.ndarray:
        """Whether the tokens of each list, joined, are its text."""
        flat = flattened(ids)
        cuts = np.r_[0, np.cumsum(self.size[flat])][np.r_[0, np.cumsum([len(one) for one in ids])]]
        joined = run_of(self.tokens.take(pa.array(flat)))
        return np.array([joined[a:b] == text for a, b, text in zip(cuts.tolist(), cuts[1:].tolist(), texts)], bool)


def flattened(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def run_of(values: pa.Array) -> bytes:
    """All bytes of texts that a kernel has just made, one after the other."""
    return values.buffers()[2].to_pybytes() if len(values) else b""


def aligned(a: list[list[int]], b: list[list[int]], a_table: Table, b_table: Table) -> list[tuple[int, bytes, np.ndarray]]:
    """For each text its number of groups, ``a1,a2|b1;a3|b2,b3`` (the ids of each group), and its links as packed pairs.

    The texts are taken as one run of bytes, as the end of each is an end of both of its lists.
    """
    one, other = flattened(a), flattened(b)
    if not len(one):
        return [(0, b"", one)] * len(a)
    a_ends, b_ends = np.cumsum(a_table.size[one]), np.cumsum(b_table.size[other])
    a_index = dict(zip(a_ends.tolist(), range(1, len(one) + 1)))
    b_index = dict(zip(b_ends.tolist(), range(1, len(other) + 1)))
    common = sorted(a_index.keys() & b_index.keys())
    a_cuts = np.array([0, *map(a_index.__getitem__, common)])
    b_cuts = np.array([0, *map(b_index.__getitem__, common)])
    a_counts, b_counts = np.diff(a_cuts), np.diff(b_cuts)
    # The slices one after the other: A's ids, then B's, each with the mark that follows it.
    a_tos, b_tos = (np.cumsum([len(ids) for ids in lists]) for lists in (a, b))
    a_marks, b_marks = np.zeros(len(one), np.int64), np.zeros(len(other), np.int64)
    a_marks[a_cuts[1:] - 1], b_marks[b_cuts[1:] - 1] = 1, 2
    b_marks[b_tos[b_tos > 0] - 1] = 3
    marked = [None] * 2
    for k, (ids, marks, table) in enumerate(((one, a_marks, a_table), (other, b_marks, b_table))):
        marked[k] = table.texts.take(pa.array(marks * len(table.size) + ids))
    place = np.empty(len(one) + len(other), np.int64)
    place[np.arange(len(one)) + np.repeat(b_cuts[:-1], a_counts)] = np.arange(len(one))
    place[np.arange(len(other)) + np.repeat(a_cuts[1:], b_counts)] = len(one) + np.arange(len(other))
    slices = pa.concat_arrays(marked).take(pa.array(place))
    sizes = pa.compute.binary_length(slices).to_numpy(zero_copy_only=False)
    joined, tos = run_of(slices), np.r_[0, np.cumsum(sizes)][np.r_[0, a_tos + b_tos]]
    # A slice's runs between neighbouring ends lie in one token of A and one of B each.
    seen = np.zeros(int(a_ends[-1]) + 1, bool)
    seen[a_ends] = seen[b_ends] = True
    runs = np.flatnonzero(seen)
    links = (one[np.searchsorted(a_ends, runs)] << SHIFT) + other[np.searchsorted(b_ends, runs)] + LEAST
    bytes_to = np.r_[0, a_ends][np.r_[0, a_tos]]
    groups, cuts = np.searchsorted(np.array(common), bytes_to, "right"), np.searchsorted(runs, bytes_to, "right")
    return [(int(groups[i + 1] - groups[i]), joined[tos[i]:tos[i + 1]], links[cuts[i]:cuts[i + 1]]) for i in range(len(a))]


ROW = ("block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>")


def _aligned_rows(files, key_type: pa.DataType):
    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.astype(np.int32)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, done = Pair(*files.value), 0
        gc.freeze()  # the vocabularies stay
        for batch in batches:
            texts = batch.column("text")
            for at, to in spans(texts, PIECE_BYTES):
                some = texts.slice(at, to - at)
                parts = batch.column("place").slice(at, to - at).to_numpy() >> 33
                rows, pairs, times, blocks = [], [], [], []
                one, other = pair.encoded([t or "" for t in some.to_pylist()])
                found = aligned(one, other, pair.a_table, pair.b_table)
                for a, b, (groups, text, links), size in zip(one, other, found, pa.compute.binary_length(some).to_pylist()):
                    held, n = np.unique(links, return_counts=True)
                    rows.append((len(a), len(b), groups, len(links), sha256(text).hexdigest() if a else ""))
                    pairs.append(held)
                    times.append(n)
                    blocks.append(done // BLOCK_BYTES)
                    done += (size or 0) + 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(at, to - at).cast(key_type), pa.array((parts << 24) + np.array(blocks, np.int64)),
                     *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), lists(pairs), lists(times)],
                    ["key", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return task


RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with what is known of their pairs."""
    order = np.argsort(answers.column("pair").to_numpy())
    pair, count = (answers.column(c).to_numpy()[order] for c in ("pair", "documents"))
    best = answers.column("best").to_numpy()[order]
    rows = rows.combine_chunks()
    held = rows.column("pairs").combine_chunks()
    owner = np.repeat(np.arange(len(rows)), pa.compute.list_value_length(held).to_numpy())
    times = rows.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    n_best = count_sum = np.zeros(len(rows), np.int64)
    if len(owner):
        place = np.searchsorted(pair, held.flatten().to_numpy())
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(rows)))]
        n_best, count_sum = (np.diff(np.r_[0, np.cumsum(v * times)][ends]) for v in (best[place].astype(np.int64), count[place]))
    added = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
    return pa.table({"key": rows.column("key")} | {c: added.get(c, None) if c in added else rows.column(c) for c in RESULTS})


def alignments(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """Per row ``key`` and ``RESULTS``: numbers of tokens, groups and links, links whose count is the highest of their A id,
    the sum of the links' counts, and the digest of the groups. ``folder`` holds the tokenizers' files on the driver."""
    spark = docs.sparkSession
    contents = []
    for name in (A_FILE, B_FILE):
        with open(f"{folder}/{name}", "rb") as file:
            contents.append(file.read())
    files = spark.sparkContext.broadcast(tuple(contents))  # two files, a few MB whatever the corpus
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).withColumn("place", F.monotonically_increasing_id())
    kind = rows.schema["key"].dataType
    rows = cut_lineage(rows.mapInArrow(_aligned_rows(files, to_arrow_type(kind)), f"key {kind.simpleString()}, {ROW}"), "aligned")
    asks = cut_lineage(rows.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(
        F.count(F.lit(1)).alias("n")), "aligned-pairs")
    known = asks.groupBy("pair").agg(F.sum("n").alias("documents"))
    known = cut_lineage(known.withColumn("a", F.shiftright(F.col("pair").cast("long") - LEAST, SHIFT)), "aligned-counts")
    most = known.groupBy("a").agg(F.max("documents").alias("most"))
    answers = asks.select("block", "pair").join(known.join(F.broadcast(most), "a").select(  # a row for each id of A at most
        "pair", "documents", (F.col("documents") == F.col("most")).cast("int").alias("best")), "pair")
    schema = f"key {kind.simpleString()}, " + ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in RESULTS)

    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return _scored(rows, answers)

    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
    return out.withColumnRenamed("key", key)
