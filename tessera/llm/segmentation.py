"""SentencePiece encoding by sampling, and lossless decoding.

The vocabulary's pieces span a lattice over a text. Forward filtering sums the probabilities of
all segmentations up to every position; backward sampling walks from the end and draws each last
piece with its share of that sum. The draws come from a hash of the row's key, the segment's
number in the text and the position, so a row gets the same segmentation in every run, on any
number of executors, and other rows with the same text get others.

A blank is the mark of a word's beginning, and one blank is put before the text. No piece holds a
blank behind another character, so the lattice falls into segments, runs of blanks with the
characters after them. Forward sums are made once for each distinct segment of a batch; only
the draws are made for each occurrence. Characters without a piece become their UTF-8 bytes'
pieces. Decoding joins the pieces' bytes and drops the first blank: every text comes back as it was.

The vocabulary file's path is a parameter; only the driver reads it. Piece probabilities follow
Zipf's law over the merge ranks that the file gives as scores.

A null text has null ids and a null text back; an empty text has no ids. Null keys share their
draws, and rows alike in key and text are segmented alike. Segments of any length are taken whole.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import layout, pieces, release, spans
from tessera.session import bound_batches

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
ZIPF_SHIFT = 10.0
PIECE_BYTES = 1_000_000
PIECE_IDS = 500_000
TABLE_BITS = 19
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces and their prefixes in an open hash table, log probabilities and bytes of every id.

    ``found`` is a piece's id, or -1 for what is only a prefix of pieces; an empty place has key 0.
    """

    keys: np.ndarray
    found: np.ndarray
    log_probability: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_log_probability: float
    bytes: np.ndarray
    ends: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL_PATH, smoothing: float = 1.0) -> Vocabulary:
        """Read a vocabulary; ``smoothing`` is the power of the probabilities (0: all pieces alike)."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        harmonic = np.log(np.sum(1 / (np.arange(size) + ZIPF_SHIFT)))
        texts, byte_ids, chance, known = [], np.zeros(256, dtype=np.int32), np.full(size, -np.inf), {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                texts.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                texts.append(b"")
            else:
                plain = piece.replace(MARK, " ")
                texts.append(plain.encode())
                rank = min(max(-model.get_score(i), 0), size)
                chance[i] = smoothing * (-np.log(rank + ZIPF_SHIFT) - harmonic)
                value = 0
                for char in plain:
                    value = _hash(char, value)
                    known.setdefault(value, -1)
                known[value] = i
        keys = np.zeros(1 << TABLE_BITS, dtype=np.uint64)
        found = np.full(len(keys), -1, dtype=np.int32)
        for value, i in known.items():
            place = int(_place(np.array([value], dtype=np.uint64))[0])
            while keys[place]:
                place = (place + 1) % len(keys)
            keys[place], found[place] = value, i
        return cls(keys, found, chance, max(len(t.decode()) for t in texts if len(t) > 1), byte_ids,
                   float(smoothing * (-np.log(size + ZIPF_SHIFT) - harmonic)),
                   np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each hash, -1 for a prefix of pieces, -2 for neither."""
        out = np.full(len(hashes), -2, dtype=np.int32)
        rows, place = np.arange(len(hashes)), _place(hashes)
        while len(rows):
            key = self.keys[place]
            hit = key == hashes[rows]
            out[rows[hit]] = self.found[place[hit]]
            on = ~hit & (key != 0)
            rows, place = rows[on], (place[on] + 1) % len(self.keys)
        return out


def _hash(text: str, start: int = 0) -> int:
    for char in text:
        start = (start * int(_PRIME) + ord(char) + 1) % (1 << 64)
    return start


def _place(hashes: np.ndarray) -> np.ndarray:
    """Where in the table a hash is looked for first."""
    return (((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct segments of a piece of texts, the segment of each occurrence, and occurrences of each text."""
    flat, at = layout(texts)
    sizes = np.diff(at)
    filled = sizes > 0
    line = np.full(len(flat) + int(filled.sum()), 32, dtype=np.uint8)
    first = at[:-1] + np.cumsum(filled) - filled  # the blank put before each text that is not empty
    place = np.arange(len(flat)) + np.repeat(first + 1 - at[:-1], sizes)
    line[place] = flat
    head = line == 32
    head[1:] &= line[:-1] != 32
    head[first[filled]] = True
    starts = np.flatnonzero(head)
    offsets = np.append(starts, len(line)).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(line))
    coded = parts.dictionary_encode()
    counts = np.zeros(len(texts), dtype=np.int64)
    counts[filled] = np.diff(np.append(np.searchsorted(starts, first[filled]), len(starts)))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts


class Lattice:
    """Forward sums of distinct segments, with the ways that lead to every position.

    A slot is a position in a segment. Slots lie in waves: all segments' first positions, then the
    second positions of those that have one, and so on, longer segments first; the next position of a
    slot is ``step`` further. The ways into a slot (its last pieces, longest first) are the rows
    ``first[slot] .. first[slot + 1]`` of ``start`` (slot before the piece), ``ids`` and ``share``, the
    cumulated chance of the way.
    """

    def __init__(self, vocabulary: Vocabulary, found: pa.Array):
        sizes = pc.utf8_length(found).to_numpy().astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes
        self.rank = np.empty(len(sizes), dtype=np.int64)
        self.rank[order] = np.arange(len(sizes))
        longest = int(sizes.max(initial=0))
        self.wave_sizes = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(longest + 1), "left")
        self.waves = np.cumsum(self.wave_sizes) - self.wave_sizes
        self.step = np.repeat(self.wave_sizes, self.wave_sizes)
        self.end = self.waves[sizes] + self.rank
        # The character after a slot is kept at the slot.
        chars = np.frombuffer("".join(found.to_pylist()).encode("utf-32-le"), np.uint32)
        place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.chars = np.zeros(len(self.step), dtype=np.uint32)
        slot = self.waves[place] + np.repeat(self.rank, sizes)
        self.chars[slot] = chars
        inner = np.zeros(len(self.step), dtype=bool)
        inner[slot] = True
        self._ways(vocabulary, inner)
        self._forward(vocabulary)

    def _ways(self, vocabulary: Vocabulary, inner: np.ndarray) -> None:
        start = np.flatnonzero(inner)
        at, value = start, np.zeros(len(start), dtype=np.uint64)
        counts, by_length = np.zeros(len(inner), dtype=np.int64), []
        for length in range(1, vocabulary.longest + 1):
            value = value * _PRIME + (self.chars[at] + np.uint64(1))
            at = at + self.step[at]
            ids = vocabulary.look_up(value)
            # A character without a piece of its own is a way by itself, through its bytes.
            way = (ids >= 0) | (length == 1)
            by_length.append((start[way], at[way], ids[way]))
            counts[at[way]] += 1
            on = (ids > -2) & inner[at]
            start, at, value = start[on], at[on], value[on]
            if not len(start):
                break
        self.first = np.append(0, np.cumsum(counts))
        total = int(self.first[-1])
        self.start, self.ids = np.zeros(total, dtype=np.int64), np.full(total, -1, dtype=np.int32)
        filled = self.first[:-1].copy()
        for starts, ends, ids in reversed(by_length):
            self.start[filled[ends]], self.ids[filled[ends]] = starts, np.maximum(ids, -1)
            filled[ends] += 1

    def gains(self, vocabulary: Vocabulary, way: np.ndarray | slice) -> np.ndarray:
        """Log probability of the pieces of ways."""
        ids = self.ids[way]
        gain = vocabulary.log_probability[ids]
        bare = ids < 0
        if bare.any():
            char = self.chars[self.start[way][bare]]
            gain[bare] = (1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)) * vocabulary.byte_log_probability
        return gain

    def _forward(self, vocabulary: Vocabulary) -> None:
        self.sums = np.zeros(len(self.step))
        self.share = np.zeros(len(self.start), dtype=np.float32)
        for low, size in zip(self.waves[1:].tolist(), self.wave_sizes[1:].tolist()):
            first = self.first[low:low + size + 1]
            ways = slice(int(first[0]), int(first[-1]))
            heads = first[:-1] - first[0]
            sums = self.sums[self.start[ways]] + self.gains(vocabulary, ways)
            many = np.diff(first)
            most = np.maximum.reduceat(sums, heads)
            chance = np.exp(sums - np.repeat(most, many))
            total = np.add.reduceat(chance, heads)
            self.sums[low:low + size] = most + np.log(total)
            run = np.cumsum(chance)
            before = run[heads] - chance[heads]
            share = ((run - np.repeat(before, many)) / np.repeat(total, many)).astype(np.float32)
            share[np.append(heads[1:], len(share)) - 1] = 2.0  # every draw takes the last way at the latest
            self.share[ways] = share

    def draw(self, segment: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ways of every occurrence, in the order of the text, and how many each has."""
        slot, place = self.end[segment], self.sizes[segment].astype(np.uint64)
        rows, steps = np.arange(len(segment)), []
        counts = np.zeros(len(segment), dtype=np.int64)
        while len(rows):
            draw = _mixed(seeds[rows] + place * _PRIME) >> np.uint64(40)
            draw = draw.astype(np.float32) / np.float32(1 << 24)
            way = self.first[slot]
            late = np.flatnonzero(self.share[way] <= draw)
            while len(late):
                way[late] += 1
                late = late[self.share[way[late]] <= draw[late]]
            steps.append((rows, way))
            counts[rows] += 1
            before = self.start[way]
            wave = np.searchsorted(self.waves, before, "right") - 1
            on = wave > 0
            rows, slot, place = rows[on], before[on], wave[on].astype(np.uint64)
        ends = np.cumsum(counts)
        ways = np.zeros(int(counts.sum()), dtype=np.int64)
        for back, (rows, way) in enumerate(steps):
            ways[ends[rows] - 1 - back] = way
        return ways, counts


def _expand(vocabulary: Vocabulary, ids: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the bytes' ids in place of characters without a piece (-1), and how many each became."""
    bare = np.flatnonzero(ids < 0)
    counts = np.ones(len(ids), dtype=np.int64)
    if not len(bare):
        return ids, counts
    coded = [chr(c).encode() for c in chars[bare].tolist()]
    counts[bare] = [len(b) for b in coded]
    out = np.repeat(ids, counts)
    out[out < 0] = vocabulary.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
    return out, counts


def encode(vocabulary: Vocabulary, texts: pa.Array, seeds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Sampled ids of each text and the log probability of the sample among all segmentations."""
    values, sizes, chances, seen = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
    for piece in pieces(texts, PIECE_BYTES):
        found, segment, per_text = segments(piece)
        lattice = Lattice(vocabulary, found)
        seed = np.repeat(seeds[seen:seen + len(piece)].astype(np.int64).view(np.uint64), per_text)
        number = np.arange(len(segment)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        seen += len(piece)
        ways, counts = lattice.draw(segment, _mixed(seed + (number + 1).astype(np.uint64) * _PRIME))
        ids, expanded = _expand(vocabulary, lattice.ids[ways], lattice.chars[lattice.start[ways]])
        text_of = np.repeat(np.arange(len(piece)), per_text)
        gain = np.bincount(np.repeat(text_of, counts), lattice.gains(vocabulary, ways), len(piece))
        whole = np.bincount(text_of, lattice.sums[lattice.end[segment]], len(piece))
        values.append(ids)
        sizes.append(np.bincount(np.repeat(text_of, counts), expanded, len(piece)).astype(np.int64))
        chances.append(gain - whole)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))), np.concatenate(chances)


def decode(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    """The text of each list of ids."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    per_text = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    size = np.diff(vocabulary.ends, prepend=0)[flat]
    ends = np.cumsum(size)
    source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(vocabulary.ends[flat] - ends, size)
    text_ends = np.concatenate([[0], ends])[np.cumsum(per_text)]
    starts = np.concatenate([[0], text_ends[:-1]])
    kept = np.ones(len(source), dtype=bool)
    kept[starts[text_ends > starts]] = False  # the blank put before the text
    line = vocabulary.bytes[source[kept]]
    dropped = np.cumsum(text_ends > starts)
    offsets = np.concatenate([[0], text_ends - dropped]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(line)))
    return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.large_string()), found).cast(pa.string())


def encoded(docs: DataFrame, key: str, text: str, path: str = MODEL_PATH, smoothing: float = 1.0,
            seed: int = 0, decoded: bool = False) -> DataFrame:
    """``docs`` with ``_ids`` and ``_log_prob`` of a sampled segmentation. Rows leave a task a piece at a time.

    ``decoded`` adds ``_decoded``, the text that the ids give back, in the same pass.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, smoothing))  # one vocabulary
    rows = docs.withColumn("_seed", F.xxhash64(F.col(key), F.lit(seed)))
    names = [*docs.columns, "_ids", "_log_prob", *["_decoded"] * decoded]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in spans(batch.column(text), PIECE_BYTES):
                part = batch.slice(at, to - at)
                ids, chance = encode(shared.value, part.column(text), part.column("_seed").to_numpy(zero_copy_only=False))
                empty = part.column(text).is_null()
                ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=empty)
                chance = pa.array(chance, mask=empty.to_numpy(zero_copy_only=False))
                made = [ids, chance, *[decode(shared.value, ids)] * decoded]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)
                del part, ids, chance, made
                release()

    empty = F.lit(None)
    schema = docs.select("*", empty.cast("array<int>").alias("_ids"), empty.cast("double").alias("_log_prob"),
                         *[empty.cast("string").alias("_decoded")] * decoded).schema
    return rows.mapInArrow(task, schema)


def decoded(rows: DataFrame, ids: str, path: str = MODEL_PATH) -> DataFrame:
    """``rows`` with ``_decoded``, the text of the ids."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    names = rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + PIECE_IDS, "right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, decode(shared.value, part.column(ids))], [*names, "_decoded"])
                at = to

    return rows.mapInArrow(task, rows.withColumn("_decoded", F.lit(None).cast("string")).schema)
