"""Quality classifier: a generalised additive model with pairwise interactions.

Every text is measured as a whole (``NAMES``). Cyclic boosting visits the features one after the
other, each time fitting a shallow tree on the feature's bins to the current residuals and adding
it to the feature's lookup table; then the pairs of features that explain most of what is left
get tables of their own in the same way. A score is a sum of table entries for the row's bins,
taken for a whole batch at once.

The fit takes at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the key; with more labels
it is a sample. Everything else covers all rows. Repeated labels of a key count once, the lowest.
Null texts count as empty; without labels of both kinds every score is the share of label 1 (0.5
without any). Null keys are never learned from. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import layout, pieces, release, words
from tessera.session import bound_batches, spread

SAMPLE_ROWS = 20_000
PIECE_BYTES = 500_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
NAMES = ("bytes", "words", "word_length", "upper", "lower", "digit", "stop", "symbol", "top_symbol", "newline",
         "distinct", "repeat", "pairs", "marked")


def _classes() -> np.ndarray:
    """Byte value x (upper, lower, digit, sentence mark, other symbol, newline); other bytes are letters."""
    kinds = np.zeros((256, 6))
    for byte in range(256):
        char = chr(byte)
        if byte >= 128 or char.islower():
            kinds[byte, 1] = 1
        elif char.isupper():
            kinds[byte, 0] = 1
        elif char.isdigit():
            kinds[byte, 2] = 1
        elif char in ".,;:'\"()?-":
            kinds[byte, 3] = 1
        elif byte > 32:
            kinds[byte, 4] = 1
        elif char == "\n":
            kinds[byte, 5] = 1
    return kinds


def _distinct(owner: np.ndarray, codes: np.ndarray, texts: int) -> np.ndarray:
    """Number of different codes (below 2^40) of each text."""
    both = (owner.astype(np.uint64) << np.uint64(40)) | codes.astype(np.uint64)
    both.sort()
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    return np.bincount((both[new] >> np.uint64(40)).astype(np.int64), minlength=texts)


def features(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    flat, at = layout(texts)
    kinds = _classes()
    n = len(texts)
    counts = np.stack([np.bincount(flat[a:b], minlength=256) for a, b in zip(at[:-1], at[1:])]) if n else np.zeros((0, 256))
    by_kind, size = counts @ kinds, np.diff(at)
    symbols = kinds[:, 4] > 0
    found, owner = words(texts)
    coded = found.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    per_text = np.bincount(owner, minlength=n)
    same_text = owner[1:] == owner[:-1]
    repeats = np.bincount(owner[1:][same_text & (ids[1:] == ids[:-1])], minlength=n)
    mixed = (ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64)
             ) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(24)
    pairs = _distinct(owner[1:][same_text], mixed[same_text], n)
    last = pc.binary_slice(pc.cast(coded.dictionary, pa.large_binary()), -1, None) if len(coded.dictionary) else None
    marked = (np.array([b != b"" and symbols[b[0]] for b in last.to_pylist()])[ids] if last is not None
              else np.zeros(0, bool))
    total, many = np.maximum(size, 1), np.maximum(per_text, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(per_text), size / many, by_kind[:, :5] / total[:, None],
        counts[:, symbols].max(axis=1, initial=0) / total, by_kind[:, 5] / total,
        _distinct(owner, ids, n) / many, repeats / many, pairs / many,
        np.bincount(owner[marked], minlength=n) / many])


def measure(texts: pa.Array) -> np.ndarray:
    """``features`` of a batch, taken in pieces of bounded size."""
    parts = [features(p) for p in pieces(texts, PIECE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


@dataclass
class Model:
    """Bin edges of each feature, its table, and tables of pairs of features over coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    start: float

    def margin(self, values: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, values[:, i], "right") for i, e in enumerate(self.edges)]
        total = np.full(len(values), self.start)
        for b, table in zip(bins, self.tables):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[_coarse(bins[i], self.edges[i]), _coarse(bins[j], self.edges[j])]
        return total

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(values), -35, 35)))


def _coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(edges) + 1)


def _gain(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad * grad / (hess + 1.0)


def _step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad / (hess + 1.0)


def _split(grad: np.ndarray, hess: np.ndarray) -> tuple[int, float]:
    """The best cut of ordered bins and what it gains."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    gains = _gain(g, h) + _gain(grad.sum() - g, hess.sum() - h) - _gain(grad.sum(), hess.sum())
    return (int(gains.argmax()) + 1, float(gains.max())) if len(gains) else (0, 0.0)


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """Value of each bin in a tree of ``depth`` cuts one below the other."""
    cut, gain = _split(grad, hess)
    if not depth or gain <= 1e-9:
        return np.full(len(grad), _step(grad.sum(), hess.sum()))
    return np.concatenate([_tree(grad[:cut], hess[:cut], depth - 1), _tree(grad[cut:], hess[cut:], depth - 1)])


def _pair_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Table of the best cut of the first feature and a cut of the second on either side, and its gain."""
    best, table = 0.0, np.zeros_like(grad)
    for cut in range(1, len(grad)):
        value, gain = np.zeros_like(grad), -_gain(grad.sum(), hess.sum())
        for part in (slice(0, cut), slice(cut, None)):
            g, h = grad[part].sum(axis=0), hess[part].sum(axis=0)
            at, more = _split(g, h)
            gain += _gain(g.sum(), h.sum()) + more
            for side in (slice(0, at), slice(at, None)):
                if g[side].size:
                    value[part, side] = _step(g[side].sum(), h[side].sum())
        if gain > best:
            best, table = gain, value
    return table, best


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting of feature tables, then of the tables of the most useful pairs."""
    share = labels.mean() if len(labels) else 0.5
    edges = [np.unique(np.quantile(v, np.arange(1, BINS) / BINS)) if len(labels) else np.zeros(0) for v in values.T]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if share in (0.0, 1.0) or not len(labels):
        return Model(edges, tables, [], float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    start = float(np.log(share / (1 - share)))
    bins = [np.searchsorted(e, v, "right") for e, v in zip(edges, values.T)]
    margin = np.full(len(labels), start)

    def sums(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return (np.bincount(cells, labels - p, size), np.bincount(cells, p * (1 - p), size))

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            step = RATE * _tree(*sums(b, len(tables[f])))
            tables[f] += step
            margin += step[b]
    shape = (PAIR_BINS, PAIR_BINS)
    coarse = [_coarse(b, e) for b, e in zip(bins, edges)]
    cells = {(i, j): coarse[i] * PAIR_BINS + coarse[j] for i in range(len(bins)) for j in range(i)}

    def pair_step(pair: tuple[int, int]) -> tuple[np.ndarray, float]:
        return _pair_tree(*(s.reshape(shape) for s in sums(cells[pair], PAIR_BINS ** 2)))

    chosen = sorted(cells, key=lambda p: (-pair_step(p)[1], p))[:PAIRS]
    grids = {p: np.zeros(shape) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            step = RATE * pair_step(p)[0]
            grids[p] += step
            margin += step.ravel()[cells[p]]
    return Model(edges, tables, [(i, j, t) for (i, j), t in grids.items()], start)


def measured(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with an array of ``NAMES`` in place of the text."""
    @F.arrow_udf("array<double>")
    def values(texts: pa.Array) -> pa.Array:
        found = measure(texts)
        offsets = np.arange(len(found) + 1, dtype=np.int32) * len(NAMES)
        release()
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    kept = [c for c in rows.columns if c != text]
    return rows.select(*kept, values(text).alias("features"))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text",
          label: str = "quality") -> Model:
    """Fit on at most ``SAMPLE_ROWS`` labelled rows of ``docs`` for which ``learnable`` (on the key) holds."""
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & learnable).groupBy(key).agg(
        F.min(label).alias("_label"))
    many = known.count()
    if many > SAMPLE_ROWS:
        known = known.filter(F.pmod(F.xxhash64(key), F.lit(many)) < int(0.95 * SAMPLE_ROWS))
    chosen = F.broadcast(known.limit(SAMPLE_ROWS))  # at most SAMPLE_ROWS keys and labels
    rows = spread(docs.select(key, text)).join(chosen, key).select("_label", F.col(text).alias("_text"))
    table = measured(rows, "_text").limit(SAMPLE_ROWS).toArrow()
    values = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    values = values.reshape(-1, len(NAMES))
    found = table.column("_label").to_numpy().astype(float)
    order = np.lexsort((found, *values.T))  # rows come in any order; sums then do not depend on it
    return fit(values[order], found[order])


def scorer(model: Model):
    """A column function from texts to scores between 0 and 1."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = pa.array(model.score(measure(texts)))
        release()
        return found

    return score
