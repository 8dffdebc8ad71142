"""Language-model scoring by context-tree weighting over bytes.

A byte is coded as eight binary decisions, one for each node of a binary tree over the byte
values. Each decision has a context tree over the preceding ``DEPTH`` bytes, whose nodes hold a
Krichevsky-Trofimov estimate of their counts; a node's weighted probability is the mean of its
own estimate and the product of its children's. A byte's probability mixes the estimates of all
depths along its context path with the weights that the training counts give them; its negative
logarithm is the code length. A text starts in a context of ``EDGE`` bytes and ends with one
(a byte that no UTF-8 text holds), so the probabilities of all texts add up to one.

The byte depends on its context only through an n-gram of ``DEPTH + 1`` bytes, so the corpus is
summed to n-gram counts. Codes have the nearest context byte first: sorted codes are the context
tree in depth-first order, and all deeper nodes below two context bytes lie in one partition.
Only the two top levels of the trees, at most 256 x 255 cells, are summed on the driver.

Texts are dealt to blocks of about ``BLOCK_BYTES``. A block gives each of its n-grams and words once, with
the number of times they occur in training texts; counts are summed, probabilities go back to the
blocks that asked for them, and a block scores its texts with its own table. Nothing that grows
with the corpus is broadcast or held in one task.

Null texts count as empty (their score is that of the end alone). Rows with null or repeated keys
are rows. Without training texts every decision has probability one half. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.texts import layout, pieces, words
from tessera.session import cut_lineage

DEPTH = 5
EDGE = 0xFF
BITS = 8
BLOCK_BYTES = 16_000_000
PIECE_BYTES = 2_000_000
PREFIX_BITS = 8 * (DEPTH - 1)  # of a code's low bits, below the two nearest context bytes
LOG2 = math.log(2.0)


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-gram code of every byte and end of the texts of a piece, and the text number of each.

    From the highest byte: the nearest context byte to the farthest, then the byte itself.
    """
    flat, at = layout(pc.ascii_lower(texts))
    sizes = np.diff(at)
    # Between texts lie DEPTH edge bytes: the first of them is the end of the text before.
    starts = at[:-1] + DEPTH * np.arange(1, len(texts) + 1)
    line = np.full(len(flat) + DEPTH * (len(texts) + 1), EDGE, dtype=np.uint64)
    line[np.arange(len(flat)) + np.repeat(starts - at[:-1], sizes)] = flat
    place = np.ones(len(line), dtype=bool)
    place[:DEPTH] = False
    for back in range(1, DEPTH):
        place[starts + sizes + back] = False
    code = line[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        code |= line[DEPTH - back:len(line) - back] << np.uint64(8 * (DEPTH + 1 - back))
    return code[place[DEPTH:]], np.repeat(np.arange(len(texts)), sizes + 1)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers: Stirling's series above 16."""
    shift = np.zeros_like(x)
    y = x.copy()
    while (low := y < 16).any():
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (
        1260 * y ** 5)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of the counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Ladder:
    """Distinct (context, byte) codes with their counts at the depths ``DEPTH`` down to ``top``.

    ``place[k]`` is the row of each n-gram at the k-th depth of the ladder, ``back[k]`` that of each row of
    the depth before.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, top: int):
        self.rows, self.sums, self.place, self.back = [grams], [counts.astype(float)], [np.arange(len(grams))], [None]
        for _ in range(DEPTH - top):
            # Drop the farthest context byte: it lies just above the byte itself.
            rows = self.rows[-1]
            shorter, back = np.unique((rows >> np.uint64(16) << np.uint64(8)) | (rows & np.uint64(0xFF)),
                                      return_inverse=True)
            self.rows.append(shorter)
            self.sums.append(np.bincount(back, self.sums[-1], len(shorter)))
            self.place.append(back[self.place[-1]])
            self.back.append(back)


class Cells:
    """Nodes of the context trees of one depth for the decisions of one bit: counts of both bit values.

    ``cell`` is the node of each row, ``first`` the first row of each node. ``weighted`` is the logarithm of
    the weighted probability, ``own`` the weight of the node's own estimate.
    """

    def __init__(self, rows: np.ndarray, sums: np.ndarray, level: int):
        shared = rows >> np.uint64(BITS - level)
        heads = np.ones(len(rows), dtype=bool)
        heads[1:] = shared[1:] != shared[:-1]
        self.first = np.flatnonzero(heads)
        self.cell = np.cumsum(heads) - 1
        bit = (rows >> np.uint64(BITS - 1 - level)) & np.uint64(1)
        self.ones = np.bincount(self.cell, sums * bit, len(self.first))
        self.zeros = np.bincount(self.cell, sums, len(self.first)) - self.ones
        self.kt = self.weighted = log_kt(self.zeros, self.ones)
        self.own = np.ones(len(self.kt))

    def over(self, deeper: Cells, back: np.ndarray) -> None:
        """Mix in the nodes one level deeper; ``back`` is the row here of each of their rows."""
        below = np.bincount(self.cell[back[deeper.first]], deeper.weighted, len(self.kt))
        self.weighted = np.logaddexp(self.kt, below) - LOG2
        self.own = np.exp(self.kt - LOG2 - self.weighted)

    def predict(self, row: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of the bit: this depth's estimate mixed with that of the deeper ones."""
        cell = self.cell[row]
        return _estimate(self.zeros[cell], self.ones[cell], self.own[cell], bit, deeper)


def _estimate(zeros, ones, own, bit, deeper):
    estimate = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    return estimate if deeper is None else own * estimate + (1 - own) * deeper


def cells_of(ladder: Ladder, level: int) -> list[Cells]:
    """Nodes of all the ladder's depths for one bit, deepest first, weighted from below."""
    found = []
    for rows, sums, back in zip(ladder.rows, ladder.sums, ladder.back):
        cells = Cells(rows, sums, level)
        if found:
            cells.over(found[-1], back)
        found.append(cells)
    return found


def log_probability(ladder: Ladder, above: Top | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each n-gram's byte in its context."""
    grams = ladder.rows[0]
    total = np.zeros(len(grams))
    for level in range(BITS):
        bit = ((grams >> np.uint64(BITS - 1 - level)) & np.uint64(1)).astype(bool)
        chance = None
        for cells, place in zip(cells_of(ladder, level), ladder.place):
            chance = cells.predict(place, bit, chance)
        if above is not None:
            chance = above.predict(grams, level, bit, chance)
        total += np.log(chance)
    return total


class Top:
    """The depths 0 and 1 of the context trees, as arrays over (nearest byte, decision node 1 to 255)."""

    def __init__(self, context: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        size = (256, 256)
        self.zeros, self.ones, product = np.zeros(size), np.zeros(size), np.zeros(size)
        self.zeros[context, node], self.ones[context, node], product[context, node] = zeros, ones, below
        kt = log_kt(self.zeros, self.ones)
        weighted = np.logaddexp(kt, product) - LOG2
        self.own = np.exp(kt - LOG2 - weighted)
        self.zeros0, self.ones0 = self.zeros.sum(axis=0), self.ones.sum(axis=0)
        kt0 = log_kt(self.zeros0, self.ones0)
        self.own0 = np.exp(kt0 - LOG2 - (np.logaddexp(kt0, weighted.sum(axis=0)) - LOG2))

    def predict(self, grams: np.ndarray, level: int, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        near = (grams >> np.uint64(8 * DEPTH)).astype(np.int64)
        node = node_of(grams, level)
        chance = _estimate(self.zeros[near, node], self.ones[near, node], self.own[near, node], bit, deeper)
        return _estimate(self.zeros0[node], self.ones0[node], self.own0[node], bit, chance)


def node_of(rows: np.ndarray, level: int) -> np.ndarray:
    """Number of the decision node (1 to 255) that a code's byte passes at ``level``."""
    byte = (rows & np.uint64(0xFF)).astype(np.int64)
    return (1 << level) | (byte >> (BITS - level))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: equal-rank bytes side by side, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(),
                       codec="zstd", asbytes=True)


def unpack(data: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, size).T).view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpack(data, size), dtype=np.uint64)


def pack_words(found: pa.Array) -> bytes:
    """Words, which hold no blanks, with a blank after each."""
    return pa.compress("".join(w + " " for w in found.to_pylist()).encode(), codec="zstd", asbytes=True)


def unpack_words(data: bytes, length: int) -> list[str]:
    return pa.decompress(data, decompressed_size=length, codec="zstd", asbytes=True).decode().split(" ")[:-1]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[heads], (np.add.reduceat(counts[order], heads) if len(keys) else counts)


# A part of a table of counts: n-grams below two nearest context bytes ("g"), or words of one hash ("w").
# ``length`` is the number of entries of a "g" part, of bytes of a "w" part's words.
PART = "kind string, part int, size long, length long, keys binary, counts binary"
PART_SCHEMA = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("size", pa.int64()), ("length", pa.int64()),
                         ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = "block long, kind string, part int, size long, length long, keys binary, found binary"
ANSWER_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("part", pa.int32()), ("size", pa.int64()),
                           ("length", pa.int64()), ("keys", pa.binary()), ("found", pa.binary())])
ASK_SCHEMA = pa.schema([("block", pa.int64()), *PART_SCHEMA])
WORD_PARTS = 256
SALT_BLOCKS = 64
MODEL_TASKS = 64
RUN = 100_000


def _gram_part(part: int, low: np.ndarray, counts: np.ndarray) -> dict:
    return {"kind": "g", "part": part, "size": len(low), "length": len(low), "keys": pack_sorted(low),
            "counts": pack(counts)}


def _word_part(part: int, found: pa.Array, counts: np.ndarray) -> dict:
    return {"kind": "w", "part": part, "size": len(found), "length": int(pc.sum(pc.binary_length(found)).as_py() or 0)
            + len(found), "keys": pack_words(found), "counts": pack(counts)}


def _word_hash(found: pa.Array) -> np.ndarray:
    """A part number for each word, from its bytes alone."""
    flat, at = layout(found)
    place = np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed *= (2 * place + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    total = np.add.reduceat(mixed, at[:-1]) if len(found) else np.zeros(0, np.uint64)
    return ((total * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)).astype(np.int64) % WORD_PARTS


def _asks(table: pa.Table) -> pa.Table:
    """Each n-gram and word of a block once, with its count in training texts, by parts."""
    learn = table.column("learn").combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint64)
    keys, counts, tokens, seen = [], [], [], 0
    for piece in pieces(table.column("text").combine_chunks(), PIECE_BYTES):
        flags = learn[seen:seen + len(piece)]
        seen += len(piece)
        code, owner = codes(piece)
        code = (code << np.uint64(1)) | flags[owner]
        code.sort()
        heads = np.flatnonzero(np.r_[True, code[1:] >> np.uint64(1) != code[:-1] >> np.uint64(1)])
        keys.append(code[heads] >> np.uint64(1))
        counts.append(np.add.reduceat(code & np.uint64(1), heads))
        found, owner = words(piece)
        coded = found.dictionary_encode()
        times = np.bincount(coded.indices.to_numpy(), flags[owner].astype(float), len(coded.dictionary))
        tokens.append(pa.table({"word": coded.dictionary, "n": pa.array(times.astype(np.int64))}))
    grams, times = merged(np.concatenate(keys), np.concatenate(counts))
    parts = (grams >> np.uint64(PREFIX_BITS)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
    low = grams & np.uint64((1 << PREFIX_BITS) - 1)
    rows = [_gram_part(int(parts[a]), low[a:b], times[a:b]) for a, b in zip(heads, np.r_[heads[1:], len(grams)])]
    every = pa.concat_tables(tokens).group_by("word").aggregate([("n", "sum")])
    if every.num_rows:
        part = _word_hash(every.column("word").combine_chunks().take(pa.array(np.arange(every.num_rows))))
        every = every.append_column("part", pa.array(part)).sort_by([("part", "ascending"), ("word", "ascending")])
        part, found = every.column("part").to_numpy(), every.column("word").combine_chunks()
        times, heads = every.column("n_sum").to_numpy(), np.flatnonzero(np.r_[True, np.diff(every.column("part").to_numpy()) > 0])
        rows += [_word_part(int(part[a]), found.slice(a, b - a), times[a:b])
                 for a, b in zip(heads, np.r_[heads[1:], len(part)])]
    block = table.column("block")[0].as_py()
    return pa.Table.from_pylist([{"block": block, **r} for r in rows], schema=ASK_SCHEMA)


def _sums(table: pa.Table) -> pa.Table:
    """One part's counts, summed over all its rows."""
    rows = table.to_pylist()
    kind, part = rows[0]["kind"], rows[0]["part"]
    if kind == "g":
        keys, counts = merged(np.concatenate([unpack_sorted(r["keys"], r["size"]) for r in rows]),
                              np.concatenate([unpack(r["counts"], r["size"]) for r in rows]))
        return pa.Table.from_pylist([_gram_part(part, keys, counts)], schema=PART_SCHEMA)
    every = pa.table({"word": pa.array([w for r in rows for w in unpack_words(r["keys"], r["length"])], pa.large_string()),
                      "n": np.concatenate([unpack(r["counts"], r["size"]) for r in rows]).astype(np.int64)})
    every = every.group_by("word").aggregate([("n", "sum")]).sort_by("word")
    return pa.Table.from_pylist([_word_part(part, every.column("word").combine_chunks(), every.column("n_sum").to_numpy())],
                                schema=PART_SCHEMA)


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training occurrences and distinct training words of each part of words."""
    for batch in batches:
        counts = [unpack(r["counts"], r["size"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(c.sum()) for c in counts], pa.int64()),
                                          pa.array([int((c > 0).sum()) for c in counts], pa.int64())], ["n", "v"])


def _grams(row: dict) -> np.ndarray:
    return unpack_sorted(row["keys"], row["size"]) | np.uint64(row["part"] << PREFIX_BITS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of n-gram parts in code order, together about ``RUN`` n-grams or one part."""
    run, size = [], 0
    for batch in batches:
        for row in sorted(batch.to_pylist(), key=lambda r: r["part"]):
            if run and (size + row["size"] > RUN or row["part"] < run[-1]["part"]):
                yield run
                run, size = [], 0
            run.append(row)
            size += row["size"]
    if run:
        yield run


def _ladder(run: list[dict]) -> Ladder:
    return Ladder(np.concatenate([_grams(r) for r in run]),
                  np.concatenate([unpack(r["counts"], r["size"]) for r in run]), 2)


def _top_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the trees below two context bytes add to the nodes below one."""
    for run in _runs(batches):
        ladder = _ladder(run)
        sums = np.zeros((3, 256 * 256))
        for level in range(BITS):
            cells = cells_of(ladder, level)[-1]
            rows = ladder.rows[-1][cells.first]
            place = (rows >> np.uint64(16)).astype(np.int64) * 256 + node_of(rows, level)
            for total, value in zip(sums, (cells.zeros, cells.ones, cells.weighted)):
                total += np.bincount(place, value, 256 * 256)
        place = np.flatnonzero(np.abs(sums).sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array((place // 256).astype(np.int32)), pa.array((place % 256).astype(np.int32)),
             *(pa.array(s[place]) for s in sums)], ["near", "node", "zeros", "ones", "below"])


def _chances(top):
    """N-gram parts with the logarithms of the probabilities in place of the counts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            chance = log_probability(_ladder(run), top.value).astype(np.float32)
            ends = np.cumsum([r["size"] for r in run])
            rows = [r | {"counts": chance[end - r["size"]:end].tobytes()} for r, end in zip(run, ends)]
            yield pa.RecordBatch.from_pylist(rows, schema=PART_SCHEMA)

    return task


def _answers(asks: pa.Table, known: pa.Table) -> pa.Table:
    """A part's asks with what is known of their entries: logarithms of probabilities, or counts of words."""
    out, (whole,) = [], known.to_pylist()
    if whole["kind"] == "g":
        grams, chance = _grams(whole), np.frombuffer(whole["counts"], np.float32)
    else:
        tokens = pa.array(unpack_words(whole["keys"], whole["length"]), pa.large_string())
        counts = unpack(whole["counts"], whole["size"])
    for row in asks.to_pylist():
        if whole["kind"] == "g":
            found = chance[np.searchsorted(grams, _grams(row))].tobytes()
        else:
            place = pc.index_in(pa.array(unpack_words(row["keys"], row["length"]), pa.large_string()), tokens)
            found = pack(counts[place.to_numpy()])
        out.append({c: row[c] for c in ANSWER_SCHEMA.names[:-1]} | {"found": found})
    return pa.Table.from_pylist(out, schema=ANSWER_SCHEMA)


def _scores(n: int, v: int, ends: int, key_type: pa.DataType):
    schema = pa.schema([("key", key_type), ("learn", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def unit(counts):
        return np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))

    def task(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return schema.empty_table()
        rows = sorted(answers.select(["kind", "part", "size", "length", "keys", "found"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
        grams = np.concatenate([_grams(r) for r in rows if r["kind"] == "g"])
        chance = np.concatenate([np.frombuffer(r["found"], np.float32) for r in rows if r["kind"] == "g"]).astype(float)
        known = pa.array([w for r in rows if r["kind"] == "w" for w in unpack_words(r["keys"], r["length"])], pa.large_string())
        counts = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["found"], r["size"]) for r in rows if r["kind"] == "w")])
        parts = []
        for piece in pieces(texts.column("text").combine_chunks(), PIECE_BYTES):
            code, owner = codes(piece)
            code = (code << np.uint64(16)) | owner.astype(np.uint64)
            code.sort()
            owner, code = (code & np.uint64(0xFFFF)).astype(np.int64), code >> np.uint64(16)
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            value = np.repeat(chance[np.searchsorted(grams, code[heads])], np.diff(np.r_[heads, len(code)]))
            score = np.bincount(owner, value, len(piece)) / math.log(10)
            found, owner = words(piece)
            coded = found.dictionary_encode()
            place = pc.index_in(coded.dictionary, known).to_numpy(zero_copy_only=False).astype(np.int64)
            times = counts[place][coded.indices.to_numpy()]
            parts.append((pc.binary_length(piece).to_numpy(zero_copy_only=False), np.bincount(owner, minlength=len(piece)) + 1,
                          np.bincount(owner, times > 0, len(piece)) + (ends > 0),
                          np.bincount(owner, unit(times), len(piece)) + unit(ends), score))
        size, tokens, met, base, score = (np.concatenate(p) for p in zip(*parts))
        return pa.Table.from_arrays(
            [texts.column("key"), texts.column("learn"), *(pa.array(c.astype(np.int64)) for c in (size, tokens, met)),
             pa.array(base), pa.array(score)], schema=schema)

    return task


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key, learn, n_bytes, n_tokens, n_known, base_score, score, train_tokens``.

    ``learn`` marks the training rows. ``score`` is the base-10 logarithm of the probability of the
    text with ASCII letters lower-cased; ``base_score`` that of its words and end under smoothed word
    frequencies. Texts are shuffled to their blocks twice, to count and to score.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    amount = rows.agg(F.sum(F.octet_length("text") + 1), F.sum(F.col("learn").cast("long"))).first()
    blocks, ends = max(1, math.ceil((amount[0] or 0) / BLOCK_BYTES)), amount[1] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
    asks = cut_lineage(rows.select("block", "text", "learn").groupBy("block").applyInArrow(_asks, "block long, " + PART),
                       "ctw-asks")
    salts = math.ceil(blocks / SALT_BLOCKS)
    salted = asks.withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
    parts = salted.drop("block")
    if salts > 1:
        parts = parts.groupBy("kind", "part", "salt").applyInArrow(_sums, PART)
    totals = cut_lineage(parts.drop("salt").groupBy("kind", "part").applyInArrow(_sums, PART), "ctw-totals")
    n, v = totals.filter("kind = 'w'").mapInArrow(_tokens_of, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    grams = totals.filter("kind = 'g'").repartition(MODEL_TASKS, "part").sortWithinPartitions("part")
    cells = grams.mapInArrow(
        _top_cells, "near int, node int, zeros double, ones double, below double").groupBy("near", "node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    found = cells.toArrow()  # at most 256 x 255 rows
    top = spark.sparkContext.broadcast(Top(*(found.column(c).to_numpy() for c in found.column_names)))
    known = grams.mapInArrow(_chances(top), PART).unionByName(totals.filter("kind = 'w'"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = salted.groupBy("kind", "part", "salt").cogroup(known.groupBy("kind", "part", "salt")).applyInArrow(
        _answers, ANSWER)
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, learn boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double"
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scores(n, v, ends, to_arrow_type(rows.schema["key"].dataType)), schema)
    return scored.withColumnRenamed("key", key).withColumn("train_tokens", F.lit(n).cast("long"))
