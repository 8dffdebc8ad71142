"""Language identification by a string kernel.

The kernel of two texts counts the n-grams of bytes (n = 1 to 3, lower-cased, signs and digits as
blanks) that occur in both, divided by the root of both texts' numbers of n-grams and averaged
over n: presence, not frequency, so length and repetition matter little. A bounded sample of
labelled texts serves as Nystroem landmarks; kernel ridge regression, one language against the
rest, is solved on the landmarks' feature space from a second bounded sample. A batch is scored by
matrix products: presence of the landmarks' n-grams times landmarks, times coefficients.

At most ``LANDMARKS`` landmarks and ``TRAIN_ROWS`` training rows are used, shared evenly by the
languages and chosen by a hash of the key; every language has a landmark, the ``LANGUAGES`` most
frequent ones are learned. Landmarks are texts of at most ``LANDMARK_BYTES`` bytes and, for languages
with too few of them, beginnings of longer ones; over ``LANDMARKS`` languages, beginnings as much
shorter. Training rows are texts of any length, and every text is scored whole. A null text, or one without a letter, is ``und`` with score 0, and so is every
text when nothing could be learned. Rows with null language or key teach nothing. Equal scores go to
the language first in code point order. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.texts import layout, pieces, release
from tessera.session import bound_batches, local_table, spread

ORDERS = (1, 2, 3)
LANDMARKS = 160
LANDMARK_BYTES = 20_000
LANGUAGES = 500
TRAIN_ROWS = 4_000
RIDGE = 1e-3
DIGITS = 4  # of the held-out evidence that is counted
SLACK = 0.7  # of the evidence that held-out texts of a language show, what a text must show
UNKNOWN = "und"
PIECE_BYTES = 500_000
PIECE_ROWS = 128  # presence is a dense matrix of this many rows; row numbers also share 32 bits with a code


def _letters() -> np.ndarray:
    """Byte x its stand-in: ASCII letters and bytes of other letters are themselves, the rest is blank."""
    byte = np.arange(256)
    letter = (byte >= 128) | ((byte >= 97) & (byte <= 122))
    return np.where(letter, byte, 32).astype(np.uint32)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, code and order of every n-gram that a text of the piece holds, once each.

    An n-gram's code has its bytes first and zeros behind; no byte is zero.
    """
    lowered = pc.utf8_lower(texts)
    flat, at = layout(lowered)
    flat = _letters()[flat]
    codes = flat << np.uint32(16)
    codes[:-1] |= flat[1:] << np.uint32(8)
    codes[:-2] |= flat[2:]
    filled = at[1:] > at[:-1]
    ends = at[1:][filled]
    codes[ends - 1] &= np.uint32(0xFF0000)
    before = ends[np.diff(at)[filled] > 1] - 2
    codes[before] &= np.uint32(0xFFFF00)
    codes |= np.repeat(np.arange(len(texts), dtype=np.uint32) << np.uint32(24), np.diff(at))
    codes.sort()
    owners, found, orders = [], [], []
    for order, mask, last in ((1, 0xFFFF0000, 0xFF0000), (2, 0xFFFFFF00, 0xFF00), (3, 0xFFFFFFFF, 0xFF)):
        cut = codes & np.uint32(mask)
        new = np.ones(len(cut), dtype=bool)
        new[1:] = cut[1:] != cut[:-1]
        cut = cut[new]
        cut = cut[(cut & np.uint32(last)) > 0]
        owners.append((cut >> np.uint32(24)).astype(np.int64))
        found.append(cut & np.uint32(0xFFFFFF))
        orders.append(np.full(len(cut), order))
    return np.concatenate(owners), np.concatenate(found), np.concatenate(orders)


def _weights(owner: np.ndarray, order: np.ndarray, texts: int) -> np.ndarray:
    """For each n-gram one over the root of its text's number of n-grams of that order."""
    cell = owner * (max(ORDERS) + 1) + order
    return (1 / np.sqrt(np.bincount(cell, minlength=texts * (max(ORDERS) + 1)).clip(1)))[cell]


@dataclass
class Landmarks:
    """Sorted n-gram codes and, for each, its weight in every landmark."""

    codes: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Landmarks:
        owners, codes, weights, seen = [], [], [], 0
        for piece in pieces(pa.array(texts, pa.string()), PIECE_BYTES, PIECE_ROWS):
            owner, code, order = grams(piece)
            owners.append(owner + seen)
            codes.append(code)
            weights.append(_weights(owner, order, len(piece)) / len(ORDERS))
            seen += len(piece)
        known, place = np.unique(np.concatenate(codes), return_inverse=True)
        matrix = np.zeros((len(known), seen), dtype=np.float32)
        matrix[place, np.concatenate(owners)] = np.concatenate(weights)
        return cls(known, matrix)

    def found(self, piece: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kernel of a piece's texts with every landmark; owner, order, place and presence of the texts' n-grams."""
        owner, code, order = grams(piece)
        weight = _weights(owner, order, len(piece))
        place = np.searchsorted(self.codes, code).clip(max=len(self.codes) - 1)
        held = self.codes[place] == code
        presence = np.zeros((len(piece), len(self.codes)), dtype=np.float32)
        presence[owner[held], place[held]] = weight[held]
        return (presence @ self.weights).astype(float), owner, order, place, held

    def kernel(self, texts: pa.Array) -> np.ndarray:
        """Kernel of every text with every landmark."""
        parts = [np.zeros((0, self.weights.shape[1]))]
        for piece in pieces(texts, PIECE_BYTES, PIECE_ROWS):
            parts.append(self.found(piece)[0])
        return np.concatenate(parts)


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    coefficients: np.ndarray
    held: np.ndarray  # language x n-gram code: whether a landmark of the language holds it

    def judged(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``predict``, with the number of each text's longest n-grams and the share of them that its language holds."""
        parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))]
        for piece in pieces(texts, PIECE_BYTES, PIECE_ROWS):
            kernel, owner, order, place, known = self.landmarks.found(piece)
            votes = kernel @ self.coefficients
            best, longest = votes.argmax(axis=1), order == max(ORDERS)
            own = known & longest
            own[own] = self.held[best[owner[own]], place[own]]
            many = np.bincount(owner[longest], minlength=len(piece))
            share = np.bincount(owner[own], minlength=len(piece)) / many.clip(1)
            parts.append((best, ((votes[np.arange(len(votes)), best] + 1) / 2).clip(0, 1), many, share))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the best language of each text and its score from 0 to 1."""
        votes = self.landmarks.kernel(texts) @ self.coefficients
        best = votes.argmax(axis=1)
        return best, ((votes[np.arange(len(votes)), best] + 1) / 2).clip(0, 1)


def solve(kernel: np.ndarray, rows: np.ndarray, labels: np.ndarray, languages: int) -> np.ndarray:
    """Ridge coefficients of the landmarks, a column for each language.

    ``kernel`` is that of the landmarks with themselves, ``rows`` that of the training rows with them.
    """
    values, vectors = np.linalg.eigh(kernel)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    spread_out = rows @ root
    wanted = np.where(labels[:, None] == np.arange(languages), 1.0, -1.0)
    ridge = spread_out.T @ spread_out + RIDGE * len(rows) * np.eye(spread_out.shape[1])
    return root @ np.linalg.solve(ridge, spread_out.T @ wanted)


def train(docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text",
          lang: str = "lang", every: bool = False) -> Model | None:
    """Learn from a bounded sample of the rows for which ``learnable`` holds; None if there are none.

    With ``every`` a language that has no such row is learned from the rows it has.
    """
    bound_batches(docs.sparkSession)
    known = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"), learnable.alias("_teach"))
    known = (known if every else known.filter("_teach")).filter(F.octet_length("_text") > 0).withColumn(
        "_long", F.octet_length("_text") > LANDMARK_BYTES)
    counts = known.groupBy("_lang").agg(F.count_if("_teach").alias("_taught"), F.count_if(F.col("_teach") & F.col("_long")).alias("_taught_long"),
                                        F.count(F.lit(1)).alias("_all"), F.count_if("_long").alias("_all_long"))
    whole = F.col("_taught") == 0
    counts = counts.select("_lang", whole.alias("_whole"), F.when(whole, F.col("_all")).otherwise(F.col("_taught")).alias("_n"), F.when(
        whole, F.col("_all_long")).otherwise(F.col("_taught_long")).alias("_n_long")).orderBy(F.desc("_n"), "_lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    languages = sorted(r["_lang"] for r in counts)
    table = local_table(docs.sparkSession, {"_lang": pa.array([r["_lang"] for r in counts], pa.string()), "_whole": pa.array(
        [r["_whole"] for r in counts], pa.bool_()), **{c: pa.array([r[c] for r in counts], pa.int64()) for c in ("_n", "_n_long")}})
    usable = F.col("_teach") | F.col("_whole")

    def hashed(seed: int) -> Column:
        return F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    # Short texts of a hash range that holds enough of them, and long ones where there are too few; then the exact share.
    share = max(1, LANDMARKS // len(counts))
    short = F.col("_n") - F.col("_n_long")
    few = F.when(F.col("_long"), (short < share) & (F.col("_u") * F.col("_n_long") < 4 * share + 8)).otherwise(
        F.col("_u") * short < 4 * share + 8)
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_long", "_u", "_text"))
    drawn = known.withColumn("_u", hashed(1)).join(F.broadcast(table), "_lang").filter(usable & few).select(
        "_lang", "_long", "_u", F.substring("_text", 1, LANDMARK_BYTES).alias("_text"))
    drawn = drawn.withColumn("_place", place).filter(F.col("_place") <= share).select("_lang", "_text").collect()
    most = LANDMARK_BYTES * LANDMARKS // max(LANDMARKS, len(counts))
    marks = sorted((r["_lang"], r["_text"].encode()[:most].decode(errors="ignore")) for r in drawn)
    landmarks = Landmarks.of([t for _, t in marks])

    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    @F.arrow_udf("array<double>")
    def kernel(texts: pa.Array) -> pa.Array:
        rows = shared.value.kernel(texts)
        release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]),
                                        pa.array(rows.ravel()))

    # A hash range that holds about 0.9 of the share; the limit is the bound itself.
    some = known.withColumn("_u", hashed(2)).join(F.broadcast(table), "_lang").filter(
        usable & (F.col("_u") * F.col("_n") < max(1, 0.9 * (TRAIN_ROWS // len(counts))))).select("_lang", "_text")
    table = spread(some).select("_lang", kernel("_text").alias("k")).limit(TRAIN_ROWS).toArrow()
    shared.unpersist()
    rows = table.column("k").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(marks))
    labels = np.array([languages.index(x) for x in table.column("_lang").to_pylist()], dtype=int)
    order = np.lexsort(rows.T[::-1])
    own = landmarks.kernel(pa.array([t for _, t in marks], pa.string()))
    of = np.array([languages.index(x) for x, _ in marks])
    held = np.stack([(landmarks.weights[:, of == i] > 0).any(axis=1) for i in range(len(languages))])
    return Model(languages, landmarks, solve(own, rows[order], labels[order], len(languages)), held)


def guess(spark: SparkSession, model: Model | None, text: str) -> Column:
    """``lang, score`` of a text column. Only texts go to the Python workers."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown
    shared = spark.sparkContext.broadcast(model)  # bounded by LANDMARKS * LANDMARK_BYTES n-grams

    @F.arrow_udf("struct<lang: string, score: double>")
    def best(texts: pa.Array) -> pa.Array:
        found, score = shared.value.predict(texts)
        release()
        names = pa.array(shared.value.languages, pa.string()).take(pa.array(found))
        return pa.StructArray.from_arrays([names, pa.array(score)], ["lang", "score"])

    return F.when(F.col(text).rlike(r"\p{L}"), best(text)).otherwise(unknown)


def cuts(docs: DataFrame, model: Model | None, held_out: Column, key: str = "doc_id", text: str = "text",
         lang: str = "lang") -> dict[str, tuple[float, float]]:
    """For each language the least score and the least share of known n-grams of a text that belongs to it.

    They are ``SLACK`` of what all but a hundredth of the held-out rows of the language reach, which rows may not be
    learned from. All of them are judged, and their evidence is counted to ``DIGITS`` digits. A language without such rows
    takes the lowest cuts of the others; without any rows there is no evidence and the cuts are 0.
    """
    if model is None:
        return {}
    rows = docs.filter(held_out & F.col(key).isNotNull() & F.col(lang).isin(model.languages) & F.col(text).rlike(r"\p{L}"))
    found = spread(rows.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"))).select(
        "_lang", F.explode(F.array(judge(docs.sparkSession, model, "_text"))).alias("j")).filter(F.col("_lang") == F.col("j.lang"))
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.round(F.col(f"j.{c}"), DIGITS).alias("value")) for c in ("score", "share")])
    counted = found.select("_lang", F.explode(sides).alias("s")).groupBy("_lang", "s").agg(F.count(F.lit(1)).alias("n"))
    low = counted.groupBy("_lang").agg(*[F.percentile(F.col("s.value"), F.lit(0.01), F.when(F.col("s.side") == c, F.col("n")).otherwise(
        F.lit(0))).alias(c) for c in ("score", "share")]).collect()
    seen = {r["_lang"]: (min(0.5, SLACK * r["score"]), SLACK * r["share"]) for r in low}
    least = tuple(map(min, zip(*seen.values()))) if seen else (0.0, 0.0)
    return {x: seen.get(x, least) for x in model.languages}


def judge(spark: SparkSession, model: Model, text: str) -> Column:
    """``lang, score, many, share`` of a text column: see ``Model.judged``. Only texts go to the Python workers."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double, many: long, share: double>")
    def judged(texts: pa.Array) -> pa.Array:
        found, *rest = shared.value.judged(texts)
        release()
        names = pa.array(shared.value.languages, pa.string()).take(pa.array(found))
        return pa.StructArray.from_arrays([names, *map(pa.array, rest)], ["lang", "score", "many", "share"])

    return judged(text)


def placed(spark: SparkSession, model: Model | None, least: dict[str, tuple[float, float]], text: str) -> Column:
    """``lang, sure`` of a text column: the language found for a text that has letters and belongs to it by the cuts
    ``least``, else a null language.

    A text of few n-grams may stay below the cuts by two standard errors; it is not ``sure`` then.
    """
    kind = "struct<lang: string, sure: boolean>"
    if model is None:
        return F.lit(None).cast(kind)
    shared, names = spark.sparkContext.broadcast(model), {x: i for i, x in enumerate(model.languages)}
    low = np.array([least[x] for x in names]).reshape(-1, 2)

    @F.arrow_udf(kind)
    def place(texts: pa.Array) -> pa.Array:
        found, score, many, share = shared.value.judged(texts)
        release()
        cut, shown = low[found], np.column_stack([score, share])
        error = 2 * np.sqrt(cut * (1 - cut) / many.clip(1)[:, None])
        languages = pa.array(shared.value.languages, pa.string()).take(pa.array(found, mask=~(shown >= cut - error).all(axis=1)))
        return pa.StructArray.from_arrays([languages, pa.array((shown >= cut).all(axis=1))], ["lang", "sure"])

    return F.when(F.col(text).rlike(r"\p{L}"), place(text))


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``_lang_pred`` and ``_lang_score``."""
    found = docs.withColumn("_guess", guess(docs.sparkSession, model, text))
    return found.withColumn("_lang_pred", F.col("_guess.lang")).withColumn(
        "_lang_score", F.col("_guess.score")).drop("_guess")
