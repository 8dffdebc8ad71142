"""Spelling variants: words one edit apart, found by bidirectional FM-index search, and the form each one follows.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The edit lies in one half of
the word searched for, so the other half stands in both. A search matches one half exactly, from its inner end to the
delimiter, and then extends across the other half with one error, up to the other delimiter. States are ranges of ranks
among the sorted suffixes of a delimited vocabulary and of its reverse, kept in step; a step is a few lookups in a
wavelet matrix for all words of a length at once.

The vocabulary is counted and dealt by Spark. A word of length N is indexed under its first (N-1)//2 and under its last
N//2 code points, and looked for where words of length N-1, N and N+1 with that beginning or end are indexed; the rest
of the vocabulary cannot hold a near word that keeps this half. A task indexes about ``SHARD_WORDS`` words. A beginning
or end of more words is cut into parts, each with an index of its own, and its words are looked for in every part.

Words are maximal runs of ``LETTERS`` with A-Z in lower case. Null and empty texts have none; repeated rows and rows with
a null key (whose number is the empty text) count like any other; an empty table has no words. Ties of the most frequent
near word go to the smallest in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, spread

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# One run in so many loses a code point; least length and count of a word; how often the form's count is the word's.
NOISE, LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 31, 7, 2, 10
SHARD_WORDS = 50_000
# States whose next symbols are listed at once.
STATES_AT_ONCE = 1 << 18


class Ranks:
    """Wavelet matrix of a text's Burrows-Wheeler transform: steps of rank ranges, and ranks' places in the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.place = suffix_array(text)
        self.last = text[self.place - 1]
        self.bits = max(1, int(symbols).bit_length())
        self.zeros, self.ones_at = [], []
        level = self.last
        for bit in range(self.bits - 1, -1, -1):
            zero = (level >> bit) & 1 == 0
            self.zeros.append(np.r_[0, np.cumsum(zero)].astype(np.int32))
            self.ones_at.append(int(self.zeros[-1][-1]))
            level = np.r_[level[zero], level[~zero]]
        counts = np.bincount(text, minlength=symbols + 1)
        self.first = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
        symbol = np.arange(symbols + 1)
        self.shift = self.first - self._sink(symbol, np.zeros(symbols + 1, np.int64))

    def _sink(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (zeros, ones_at) in enumerate(zip(self.zeros, self.ones_at)):
            before = zeros[at]
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, ones_at + at - before, before)
        return at

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges after one more symbol, and how many entries of the old ranges had a smaller one."""
        smaller = np.zeros(len(low), np.int64)
        for level, (zeros, ones_at) in enumerate(zip(self.zeros, self.ones_at)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            smaller += np.where(one, b - a, 0)
            low = np.where(one, ones_at + low - a, a)
            high = np.where(one, ones_at + high - b, b)
        shift = self.shift[symbol]
        return low + shift, high + shift, smaller


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes in order; beyond the end lies nothing."""
    n, width = len(text), 7
    padded = np.r_[text.astype(np.int64) + 1, np.zeros(width, np.int64)]
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << 8) | padded[k:k + n]
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.r_[True, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            return order
        key = rank * (n + 1) + np.r_[rank, np.zeros(width, np.int64)][width:width + n]
        width *= 2


class Index:
    """A vocabulary between delimiters, ranked forwards and backwards."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, symbols: int):
        """``codes``: symbols from 1 on of all words in a row."""
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]) + 1, np.uint8)
        inside = np.ones(len(text), bool)
        inside[np.r_[0, ends]] = False
        text[inside] = codes
        self.symbols, self.size = symbols, len(text)
        self.word_at = np.cumsum(~inside) - 1  # number of the word after a delimiter
        self.forward, self.backward = Ranks(text, symbols), Ranks(text[::-1], symbols)

    def found(self, rank: np.ndarray, backwards: bool) -> np.ndarray:
        """Words at ranks of whole delimited words in one of the two orders."""
        if backwards:
            return self.word_at[self.size - 1 - self.backward.place[rank]] - 1
        return self.word_at[self.forward.place[rank]]

    def matched(self, half: np.ndarray, backwards: bool, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``half`` (symbols in the order of matching) that stand before a delimiter in some word, and their
        ranges in the opposite order; a row of ``known`` that only meets itself goes."""
        ranks = self.backward if backwards else self.forward
        rows = np.arange(len(half))
        low, high, other = (np.full(len(half), v, np.int64) for v in (0, self.size, 0))
        for symbol in [*half.T, np.zeros(len(half), half.dtype)]:
            low, high, smaller = ranks.step(low, high, symbol[rows].astype(np.int64))
            other = other + smaller
            keep = high - low > known[rows]
            rows, low, high, other = rows[keep], low[keep], high[keep], other[keep]
        return rows, other, other + high - low

    def branches(self, ranks: Ranks, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (state, symbol) whose range goes on with a symbol that is no delimiter."""
        wide = high - low > self.symbols
        state = [np.repeat(np.flatnonzero(wide), self.symbols)]
        symbol = [np.tile(np.arange(1, self.symbols + 1), int(wide.sum()))]
        small = np.flatnonzero(~wide)
        size = (high - low)[small]
        at = np.repeat(low[small] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        pair = np.unique(np.repeat(small, size) * 256 + ranks.last[at])
        state.append(pair >> 8)
        symbol.append(pair & 255)
        state, symbol = np.concatenate(state), np.concatenate(symbol)
        return state[symbol > 0], symbol[symbol > 0]

    def one_error(self, half: np.ndarray, rest: np.ndarray, backwards: bool, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of all words that have ``half`` and the delimiter on its outer side, and ``rest`` (in the order
        of extension, from the half outwards) with exactly one edit."""
        ranks = self.forward if backwards else self.backward
        rows, low, high = self.matched(half, backwards, known)
        none = np.zeros(0, np.int64)
        err = (none, none, none)
        width = rest.shape[1]
        for j in range(width + 1):
            last = j == width
            state, symbol = self.branches(ranks, low, high)
            wanted = None if last else rest[rows, j].astype(np.int64)
            if not last:
                other = symbol != wanted[state]
                state, symbol = state[other], symbol[other]
            a, b, _ = ranks.step(low[state], high[state], symbol)
            filled = b > a
            changed = (rows[state][filled], a[filled], b[filled])
            err = tuple(np.concatenate(x) for x in zip(err, changed))  # inserted before symbol j
            symbol = np.zeros(len(err[0]), np.int64) if last else rest[err[0], j].astype(np.int64)
            a, b, _ = ranks.step(err[1], err[2], symbol)
            filled = b > a
            err = (err[0][filled], a[filled], b[filled])
            if last:
                return err[0], self.found(err[1], not backwards)
            # Replaced by another symbol, or left out (the last of a run of equal symbols stands for all of it).
            left_out = np.ones(len(rows), bool) if j + 1 == width else rest[rows, j + 1] != wanted
            err = tuple(np.concatenate(x) for x in zip(err, changed, (rows[left_out], low[left_out], high[left_out])))
            low, high, _ = ranks.step(low, high, wanted)
            keep = high - low > known[rows]
            rows, low, high = rows[keep], low[keep], high[keep]
            if not len(rows) and not len(err[0]):
                return none, none


def near_words(words: list[str], indexed: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, near) numbers into ``words``: for each word the ``indexed`` ones that are one edit away and share its
    beginning (``ends``: its end) half."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    alphabet, codes = np.unique(points, return_inverse=True)
    if len(alphabet) > 254:
        raise ValueError("more than 254 different code points")
    codes = (codes + 1).astype(np.uint8)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    target = np.flatnonzero(indexed)
    index = Index(codes[np.repeat(indexed, lengths)], lengths[target], len(alphabet))
    found = []
    for length in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == length)
        for at in range(0, len(same), max(1, STATES_AT_ONCE // length)):
            part = same[at:at + max(1, STATES_AT_ONCE // length)]
            letters = codes[starts[part][:, None] + np.arange(length)]
            front, back = letters[:, :length // 2], letters[:, length // 2:]
            half, rest = (back, front[:, ::-1]) if ends else (front[:, ::-1], back)
            row, word = index.one_error(half, rest, ends, indexed[part].astype(np.int64))
            found.append((part[row], target[word]))
    one, other = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return one, other


PAIRS = "word string, near string, near_n long"


def _searched(rows: pa.Table) -> pa.Table:
    """Near words of a shard, each (word, indexed word) once."""
    out = []
    for ends in (False, True):
        some = rows.filter(pa.compute.equal(rows.column("ends"), ends))
        if not len(some) or not pa.compute.any(some.column("indexed")).as_py():
            continue
        words = some.column("word").combine_chunks()
        one, other = near_words(words.to_pylist(), some.column("indexed").to_numpy(), ends)
        pair = np.unique(np.c_[one, other], axis=0)
        n = some.column("n").combine_chunks()
        out.append(pa.table({"word": words.take(pa.array(pair[:, 0])), "near": words.take(pa.array(pair[:, 1])),
                             "near_n": n.take(pa.array(pair[:, 1]))}))
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    return pa.concat_tables([schema.empty_table(), *(t.cast(schema) for t in out)])


def noisy(run: Column, key: Column) -> Column:
    """The lower-cased run, which loses the code point that its hash names if ``NOISE`` divides the hash."""
    lower = F.translate(run, UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), lower).cast("binary"))
    at = (h % F.length(lower)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(lower, F.lit(1), at), F.substring(lower, at + 2, F.length(lower)))).otherwise(lower)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of all words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    words = spread(docs.select(F.col(key).alias("key"), F.col(text).alias(text))).select("key", F.explode(runs).alias("run"))
    words = words.select(noisy(F.col("run"), F.col("key")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def near_pairs(words: DataFrame, shard_words: int | None = None) -> DataFrame:
    """``word, near, near_n`` of every ordered pair of near words of ``word, n``; no word may stand there twice."""
    shard_words = shard_words or SHARD_WORDS
    length = F.length("word")
    targets = F.array(length - 1, length, length + 1)
    rows = words.select("word", "n", length.alias("length"), F.explode(targets).alias("target"))
    rows = rows.select("word", "n", "length", "target", F.explode(F.array(F.lit(False), F.lit(True))).alias("ends"))
    half = F.when(F.col("ends"), F.expr("right(word, div(target, 2))")).otherwise(F.expr("left(word, div(target - 1, 2))"))
    own = F.col("target") == F.col("length")
    rows = rows.withColumn("place", F.xxhash64("ends", "target", half))
    counts = rows.groupBy("place").agg(F.count_if(own).alias("held"), F.count(F.lit(1)).alias("asking"))
    shards = max(1, -(-2 * words.count() // shard_words))
    # Places without an indexed word, or with one that only itself looks for, are not searched.
    dealt = rows.join(counts.filter("held > 0 and asking > 1"), "place")
    parts = F.ceil(F.col("held") / shard_words).cast("int")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    indexed = own & (F.pmod(F.xxhash64("word"), parts) == F.col("part"))
    # Every place has its task, or every part of a place that is cut.
    shard = F.pmod(F.xxhash64("place", "part"), F.lit(shards)).cast("int")
    dealt = dealt.select("word", "n", "ends", indexed.alias("indexed"), shard.alias("shard"))

    def searched(rows: pa.Table) -> pa.Table:
        return _searched(rows)

    found = dealt.groupBy("shard").applyInArrow(searched, PAIRS)
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the near word that a word follows, and the end of that chain."""
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    follows = -F.col("best.least") >= FORM_TIMES * F.col("n")
    rows = cut_lineage(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(follows, F.col("best.near")).alias("form"),
                                   F.when(follows, -F.col("best.least")).alias("form_n")), "word-forms")
    links = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; counts grow tenfold a step, so rounds are few
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = links.join(onward, "root", "left")
        if not moved.filter("onward is not null").head(1):
            break
        links = cut_lineage(moved.select("word", F.coalesce("onward", "root").alias("root")), "word-roots")
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word of the vocabulary ``word, form, root, n, n_near, form_n``."""
    words = cut_lineage(vocabulary(docs, key, text), "vocabulary")
    return forms(words, near_pairs(words))


def sql() -> str:
    """The same for ``documents`` in DuckDB: near words share what is left when one code point goes."""
    return f"""WITH RECURSIVE table_steps AS (SELECT 0 AS k, range AS b, range AS v FROM range(256)
  UNION ALL SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM table_steps WHERE k < 8),
crc_table AS (SELECT b, v FROM table_steps WHERE k = 8),
runs AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS times FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST_LENGTH},}}')) AS run FROM documents) GROUP BY ALL),
sums AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes, 0 AS pos,
    4294967295 AS acc FROM runs
  UNION ALL SELECT run, times, bytes, pos + 1, xor(acc >> 8, v) FROM sums JOIN crc_table
    ON b = xor(acc & 255, CAST('0x' || substr(bytes, 2 * pos + 1, 2) AS BIGINT)) WHERE 2 * pos < length(bytes)),
hashed AS (SELECT run, times, xor(acc, 4294967295) AS h FROM sums WHERE 2 * pos = length(bytes)),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % {NOISE} = 0
    THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (
  SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
ranked AS (SELECT near.word, near.near, w.n, count(*) OVER (PARTITION BY near.word) AS n_near,
  row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS r FROM near JOIN words w ON near.near = w.word),
formed AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= {FORM_TIMES} * words.n THEN near END AS form,
  CASE WHEN r.n >= {FORM_TIMES} * words.n THEN r.n END AS form_n FROM words LEFT JOIN ranked r ON words.word = r.word AND r.r = 1),
chain AS (SELECT word, word AS root FROM formed
  UNION ALL SELECT chain.word, form FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
