"""Document fingerprints from a randomised edit embedding.

Every text walks along a line of output positions: at each position a coin, shared by all texts and
fixed by the position and the character, says whether the walk moves on to the next character.
Texts that differ by few edits fall into step again after an edit, so the share of positions at which
they stand on different characters (a Hamming distance) follows their edit distance. The
fingerprint samples the line: ``SAMPLES`` positions of each octave (all of the short ones), each as four
hashed bits of the character there, up to the walk's end. Weighting samples by the length of
line they stand for, two fingerprints give the likeness of two whole texts of any length.

Bands of sampled symbols from a fingerprint's last octaves bring near texts together
(``bands``); a candidate pair is verified by its likeness. Equal fingerprints are one candidate, and
a bucket's members are verified against its first and its last, so no bucket makes all pairs.

Null texts count as empty: an empty fingerprint, like only itself. In the order of keys null ones
come last and equal keys go by text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import spans

PERIOD = 1 << 14
KINDS = 64
SAMPLES = 64
OCTAVES = 44
SCALAR = 64
BANDS = 8
BAND_SYMBOLS = 8
BUCKET_BYTES = 8_000_000
PIECE_BYTES = 4_000_000
FINER = 4  # candidates for each bucket boundary, of which every fourth is taken
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _steps() -> np.ndarray:
    """Positions that a character of each kind holds when reached at each position of a period."""
    coins = (_mixed(np.arange(KINDS * PERIOD, dtype=np.uint64) * _GOLD) >> np.uint64(63)).astype(bool).reshape(KINDS, PERIOD)
    place = np.arange(2 * PERIOD)
    heads = np.where(np.concatenate([coins, coins], axis=1), place, 2 * PERIOD)
    first = np.minimum.accumulate(heads[:, ::-1], axis=1)[:, ::-1]
    return (first - place + 1)[:, :PERIOD].astype(np.uint8)


STEPS = _steps()
_STEP_ROWS = [row.tobytes() for row in STEPS]


def _sample_places() -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions in order, and the length of line each stands for."""
    places, weights = [], []
    for octave in range(OCTAVES):
        low, size = (1 << octave) - 1, 1 << octave
        if size <= SAMPLES:
            found = np.arange(size)
        else:  # one in each of SAMPLES equal stretches
            stretch = size // SAMPLES
            draws = _mixed((np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1 + octave * SAMPLES)) * _GOLD)
            found = np.arange(SAMPLES) * stretch + (draws % np.uint64(stretch)).astype(np.int64)
        places.append(low + found)
        weights.append(np.full(len(found), size / len(found)))
    return np.concatenate(places), np.concatenate(weights)


PLACES, WEIGHTS = _sample_places()
_WEIGHT_SUMS = np.concatenate([[0.0], np.cumsum(WEIGHTS)])
_OCTAVE_ENDS = np.cumsum([min(1 << octave, SAMPLES) for octave in range(OCTAVES)])
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def kinds(chars: np.ndarray) -> np.ndarray:
    return (_mixed(chars.astype(np.uint64) * _GOLD + np.uint64(7)) % np.uint64(KINDS)).astype(np.uint8)


def walk(kind: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Position at which each character of each text is reached, and the ends after each text's last.

    Text i has the characters ``at[i] .. at[i + 1]`` and starts at position ``start[i]``. All texts go on
    by one character at a time; when few are left, each is walked alone.
    """
    sizes = np.diff(at)
    reached = np.zeros(len(kind) + len(sizes), dtype=np.int64)
    out = at[:-1] + np.arange(len(sizes))  # text i's first place in ``reached``
    order = np.argsort(-sizes, kind="stable")
    base, target, now, size = at[:-1][order], out[order], start[order].astype(np.int64), sizes[order]
    flat, step = STEPS.ravel(), 0
    left = int(np.searchsorted(-size, 0, "left"))  # texts with a character at this step
    while left >= SCALAR:
        reached[target[:left] + step] = now[:left]
        here = kind[base[:left] + step].astype(np.int64)
        now[:left] += flat[here * PERIOD + (now[:left] & (PERIOD - 1))]
        step += 1
        left = int(np.searchsorted(-size[:left], -step, "left"))
    for i in range(left):
        rest = kind[base[i] + step:base[i] + size[i]].tobytes()
        line = accumulate(rest, lambda j, c: j + _STEP_ROWS[c][j & (PERIOD - 1)], initial=int(now[i]))
        reached[target[i] + step:target[i] + size[i] + 1] = np.fromiter(line, np.int64, len(rest) + 1)
    done = np.arange(left, len(size))
    reached[target[done] + size[done]] = now[done]
    return reached


def _symbols(chars: np.ndarray, samples: np.ndarray) -> np.ndarray:
    mixed = _mixed(chars.astype(np.uint64) * _GOLD + samples.astype(np.uint64))
    return _HEX[(mixed >> np.uint64(60)).astype(np.int64)]


def _sampled(reached: np.ndarray) -> np.ndarray:
    """Number of the character at each sampled place before the end of a walk."""
    many = int(np.searchsorted(PLACES, reached[-1], "left"))
    return np.searchsorted(reached[:-1], PLACES[:many], "right") - 1


def likeness(one: bytes, other: bytes) -> float:
    """Estimated share of the longer line on which both stand on the same character."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    if not len(a) and not len(b):
        return 1.0
    both = min(len(a), len(b))
    same = float(WEIGHTS[:both][a[:both] == b[:both]].sum()) / float(_WEIGHT_SUMS[max(len(a), len(b))])
    return max(0.0, (same - 1 / 16) / (15 / 16)) if same < 1 else 1.0


@cache
def _band_places(octave: int) -> np.ndarray:
    """Sample numbers of each band over the last two octaves up to this one."""
    end = sum(min(1 << o, SAMPLES) for o in range(octave + 1))
    low = max(0, end - 2 * SAMPLES)
    draws = _mixed((np.arange(BANDS * BAND_SYMBOLS, dtype=np.uint64) + np.uint64(1 + 1000 * octave)) * _GOLD)
    return low + (draws % np.uint64(end - low)).astype(np.int64)


def bands(print_: bytes) -> list[str]:
    """Band keys from the last octave that a fingerprint fills, and from the one before."""
    symbols, keys = np.frombuffer(print_, np.uint8), []
    full = int(np.searchsorted(_OCTAVE_ENDS, len(print_), "right"))
    for octave in range(max(0, full - 2), full):
        chosen = symbols[_band_places(octave)].tobytes().decode()
        keys += [f"{octave}-{i}-{chosen[i * BAND_SYMBOLS:(i + 1) * BAND_SYMBOLS]}" for i in range(BANDS)]
    return keys or ["short-" + print_.decode()]


def prints(texts: list[str], followers: list[str] | None = None) -> tuple[list[bytes], list[bytes], list[str]]:
    """Fingerprints of the texts and, with ``followers``, of their edited texts, and those texts.

    An edited text has the text's last third replaced by as many of the follower's first characters.
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    reached = walk(kinds(chars), at, np.zeros(len(texts), dtype=np.int64))
    first = at[:-1] + np.arange(len(texts))
    own = [reached[f:f + n + 1] for f, n in zip(first.tolist(), sizes.tolist())]
    found = [_print(chars[a:a + n], _sampled(w)) for a, n, w in zip(at.tolist(), sizes.tolist(), own)]
    if followers is None:
        return found, [], []
    heads = [t[:len(t) - len(t) // 3] for t in texts]
    tails = [f[:len(t) // 3] for t, f in zip(texts, followers)]
    more = np.frombuffer("".join(tails).encode("utf-32-le", "surrogatepass"), np.uint32)
    tail_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tails), np.int64, len(tails)))])
    cut = np.fromiter(map(len, heads), np.int64, len(heads))
    tail_reached = walk(kinds(more), tail_at, reached[first + cut])
    tail_first = tail_at[:-1] + np.arange(len(tails))
    edited = []
    for i, (head, tail) in enumerate(zip(heads, tails)):
        line = np.concatenate([own[i][:len(head)], tail_reached[tail_first[i]:tail_first[i] + len(tail) + 1]])
        both = np.concatenate([chars[at[i]:at[i] + len(head)], more[tail_at[i]:tail_at[i] + len(tail)]])
        edited.append(_print(both, _sampled(line)))
    return found, edited, [h + t for h, t in zip(heads, tails)]


def _print(chars: np.ndarray, places: np.ndarray) -> bytes:
    return _symbols(chars[places], np.arange(len(places))).tobytes()


def fingerprinted(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``_print`` in place of the text."""
    @F.arrow_udf("string")
    def value(texts: pa.Array) -> pa.Array:
        return pa.array([p.decode() for p in prints([t or "" for t in texts.to_pylist()])[0]], pa.string())

    kept = [c for c in rows.columns if c != text]
    return rows.select(*kept, value(text).alias("_print"))


def near_pairs(rows: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """``first, other, likeness`` of classes of equal ``_print``, named by their smallest key.

    Each bucket of a band verifies its members against its first and its last, so a bucket gives at most
    two pairs a member; members that differ from both may still meet in another band.
    """
    @F.arrow_udf("array<string>")
    def keys(prints_: pa.Array) -> pa.Array:
        return pa.array([bands(p.encode()) for p in prints_.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("double")
    def alike(one: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([likeness(a.encode(), b.encode()) for a, b in zip(one.to_pylist(), other.to_pylist())])

    classes = rows.groupBy("_print").agg(F.min(key).alias("name"))
    held = classes.select("name", "_print", F.explode(keys("_print")).alias("band"))
    place = F.struct("name", "_print")
    ends = held.groupBy("band").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    pairs = held.join(ends, "band").select(
        F.explode(F.array("low", "high")).alias("end"), F.col("name").alias("other"), F.col("_print").alias("_other"))
    pairs = pairs.select(F.col("end.name").alias("first"), F.col("end._print").alias("_one"), "other", "_other").filter(
        "_one <> _other").distinct()
    return pairs.withColumn("likeness", alike("_one", "_other")).filter(F.col("likeness") >= least).select(
        F.least("first", "other").alias("first"), F.greatest("first", "other").alias("other"), "likeness").distinct()


def _compare(table: pa.Table) -> pa.Table:
    """Fingerprints of a bucket's texts, of their edited texts, and their likenesses, a piece at a time."""
    table = table.sort_by([("order", "descending"), ("text", "ascending")])
    guest = table.column("guest")
    own, guests = table.filter(pc.invert(guest)).combine_chunks(), table.filter(guest)
    texts, parts = own.column("text"), []
    for at, to in spans(texts.combine_chunks(), PIECE_BYTES) if len(own) else ():
        mine = texts.slice(at, to - at).to_pylist()
        after = texts[to] if to < len(own) else (guests.column("text")[0] if len(guests) else texts[0])
        followers = [*mine[1:], after.as_py()]
        found, edited, changed = prints(mine, followers)
        last, _, _ = prints(followers[-1:])
        rows = []
        for text, one, two, new, follower in zip(mine, found, edited, changed, [*found[1:], *last]):
            names = set(bands(one))
            rows.append((len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), one.decode(), two.decode(),
                         likeness(one, two), likeness(one, follower), not names.isdisjoint(bands(two)),
                         not names.isdisjoint(bands(follower))))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(COMPARED)[1:])]
        parts.append(pa.Table.from_arrays([own.column("key").slice(at, to - at), *columns], schema=COMPARED))
    return pa.concat_tables(parts) if parts else COMPARED.empty_table()


COMPARED = pa.schema([("key", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                      ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                      ("near_next", pa.float64()), ("candidate_edited", pa.bool_()), ("candidate_next", pa.bool_())])


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text beside its edited text and the next text in descending order of (long) keys.

    Ranges of keys with about ``BUCKET_BYTES`` of text are one task each. Boundaries are keys chosen by
    hash, so a range's last row has its next text in the row that bounds the range below, which is sent there too.
    Texts are shuffled once. Candidate boundaries, ``FINER`` numbers for each bucket, come to the driver: 50
    million for 100 TB, or 400 MB.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("order"))
    size, many, top = rows.agg(F.sum(F.octet_length("text").cast("long") + 1), F.count(F.lit(1)), F.max("order")).first()
    share = max(1, math.floor((many or 0) * BUCKET_BYTES / max(1, size or 1) / FINER))
    found = rows.filter(F.pmod(F.xxhash64("order"), F.lit(share)) == 0).select("order").toArrow()
    chosen = np.unique(found.column("order").to_numpy())[::FINER]
    bounds = np.unique(np.append(chosen, top)) if many else np.zeros(1, dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)  # one number a bucket

    @F.arrow_udf("array<struct<bucket: int, guest: boolean>>")
    def deal(orders: pa.Array) -> pa.Array:
        order = orders.to_numpy(zero_copy_only=False)
        place = np.searchsorted(shared.value, order, "left")
        bound = shared.value[place] == order
        many = len(shared.value)
        return pa.array([[{"bucket": int(p), "guest": False}, {"bucket": int(p + 1) % many, "guest": True}] if b
                         else [{"bucket": int(p), "guest": False}] for p, b in zip(place, bound)],
                        pa.list_(pa.struct([("bucket", pa.int32()), ("guest", pa.bool_())])))

    dealt = rows.withColumn("to", F.explode(deal("order"))).select("key", "text", "order", "to.*")
    schema = ("key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, candidate_edited boolean, candidate_next boolean")
    return dealt.groupBy("bucket").applyInArrow(_compare, schema).withColumnRenamed("key", key)
