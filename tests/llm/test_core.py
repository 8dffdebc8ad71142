"""The arithmetic inside tasks, against plain versions of the same definitions."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ctw, editprint, language, quality, resharding, segmentation, simhash, texts, topk
from tests.llm.edges import LONG, UNBROKEN

WORDY = st.text(alphabet=st.sampled_from(list("abzAZ  \n\té▁😀.1")), max_size=40)


@given(st.lists(st.one_of(st.none(), WORDY), max_size=12), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_words_and_layout(given_texts, most):
    seen = []
    for piece in texts.pieces(pa.array(given_texts, pa.string()), most, 5):
        flat, at = texts.layout(piece)
        assert bytes(flat) == "".join(piece.to_pylist()).encode() and at[-1] == len(flat)
        found, owner = texts.words(piece)
        want = [(i, w) for i, t in enumerate(piece.to_pylist()) for w in t.encode().lower().split()]
        assert [(o, w.encode()) for o, w in zip(owner.tolist(), found.to_pylist())] == want
        seen += piece.to_pylist()
    assert seen == [t or "" for t in given_texts]


# Flows ------------------------------------------------------------------------------------------

def cheapest(supply, capacity, cost):
    """Least cost over all whole-numbered flows."""
    best = math.inf

    def fill(i, room, total):
        nonlocal best
        if total >= best:
            return
        if i == len(supply):
            best = total
            return
        for split in itertools.product(*(range(min(supply[i], r) + 1) for r in room)):
            if sum(split) == supply[i]:
                fill(i + 1, [r - s for r, s in zip(room, split)], total + sum(c * s for c, s in zip(cost[i], split)))

    fill(0, list(capacity), 0)
    return best


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_flow_has_least_cost(data):
    supply = data.draw(st.lists(st.integers(0, 4), min_size=1, max_size=3))
    capacity = data.draw(st.lists(st.integers(0, 4), min_size=1, max_size=3))
    capacity[-1] += max(0, sum(supply) - sum(capacity))
    cost = [[data.draw(st.integers(0, 5)) for _ in capacity] for _ in supply]
    flow = resharding.min_cost_flow(supply, capacity, np.array(cost))
    assert flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= capacity).all() and (flow >= 0).all()
    assert (flow * cost).sum() == cheapest(supply, capacity, cost)


def test_flow_needs_room():
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [2], np.zeros((1, 1)))


# Top-k ------------------------------------------------------------------------------------------

@given(st.integers(0, 10 ** 6))
@settings(max_examples=80, deadline=None)
def test_search_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows, length, k = int(rng.integers(1, 300)), int(rng.integers(0, 5)), int(rng.integers(1, 12))
    matrix = rng.integers(-4, 5, (rows, length))
    ids = rng.permutation(1000)[:rows]
    asked = rng.integers(0, rows, 4)
    for q, (found, scores) in zip(asked, topk.search(ids[asked], matrix[asked], ids, matrix, k)):
        order = sorted((-int(matrix[i] @ matrix[q]), int(ids[i]), i) for i in range(rows) if ids[i] != ids[q])[:k]
        assert found.tolist() == [i for _, _, i in order] and scores.tolist() == [-s for s, _, _ in order]


# SimHash ----------------------------------------------------------------------------------------

def slow_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


@given(st.one_of(st.none(), WORDY), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) == slow_fingerprint(text, width)


def united(values, groups, distance):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        near = np.flatnonzero((groups == groups[i]) & (np.bitwise_count(values ^ values[i]) <= distance))
        for j in near.tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("seed", range(20))
def test_index_links_all_near_pairs(seed):
    rng = np.random.default_rng(seed)
    rows = int(rng.integers(1, 300))
    values = rng.integers(0, 1 << 63, 12, dtype=np.uint64)[rng.integers(0, 12, rows)]
    for _ in range(seed % 8):
        values = values ^ ((np.uint64(1) << rng.integers(0, 64, rows).astype(np.uint64)) * rng.integers(0, 2, rows).astype(np.uint64))
    both = np.unique(np.stack([rng.integers(0, 4, rows).astype(np.uint64), values]), axis=1)
    groups, values = both[0].astype(int), both[1]
    index = simhash.GrayIndex(groups, values)
    order = np.lexsort((simhash.gray_rank(values), groups))
    assert (index.values == values[order]).all()
    assert index.labels(4).tolist() == united(values[order], groups[order], 4)


def test_tables_bring_linked_pairs_together():
    rng = np.random.default_rng(3)
    for many in (10, 10 ** 6, 10 ** 9, 10 ** 12):
        masks = simhash._tables(many, 4)
        for _ in range(300):
            differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not differ & m for m in masks)


# Quality and language ---------------------------------------------------------------------------

def test_quality_model_learns_interactions():
    rng = np.random.default_rng(0)
    values = rng.random((3000, 3))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    model = quality.fit(values, labels)
    assert ((model.score(values) > 0.5) == labels).mean() > 0.95  # no sum of single features can tell
    assert model.pairs[0][:2] == (1, 0)


@pytest.mark.parametrize("labels", [[], [1.0], [0.0, 0.0]])
def test_quality_of_one_kind(labels):
    model = quality.fit(np.zeros((len(labels), len(quality.NAMES))), np.array(labels))
    score = model.score(quality.measure(pa.array(["some text", "", None])))
    assert np.allclose(score, labels[0] if labels else 0.5, atol=1e-5)


def test_quality_features():
    row = dict(zip(quality.NAMES, quality.measure(pa.array(["the the cat! Sat 12"]))[0]))
    assert row["words"] == math.log(6) and row["distinct"] == 4 / 5 and row["repeat"] == 1 / 5
    assert row["marked"] == 1 / 5 and row["digit"] == 2 / 19 and row["pairs"] == 4 / 5
    assert np.isfinite(quality.measure(pa.array(["", None, " ", LONG, UNBROKEN]))).all()


def gram_sets(text):
    line = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    return [{line[i:i + n] for i in range(len(line) - n + 1)} for n in language.ORDERS]


@given(st.lists(WORDY.filter(bool), min_size=1, max_size=6), st.lists(WORDY, min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_kernel(marks, given_texts):
    kernel = language.Landmarks.of(marks).kernel(pa.array(given_texts, pa.string()))
    for i, a in enumerate(given_texts):
        for j, b in enumerate(marks):
            want = sum(len(x & y) / math.sqrt(len(x) * len(y)) for x, y in zip(gram_sets(a), gram_sets(b)) if x and y)
            assert abs(kernel[i, j] - want / len(language.ORDERS)) < 1e-5


# Context trees ----------------------------------------------------------------------------------

def kt(zeros, ones):
    return math.exp(math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi))


def weighted(counts, context, depth):
    """Weighted probability of a node's subtree: ``counts`` maps contexts (nearest byte first) to [zeros, ones]."""
    zeros = sum(c[0] for k, c in counts.items() if k[:depth] == context)
    ones = sum(c[1] for k, c in counts.items() if k[:depth] == context)
    if depth == ctw.DEPTH:
        return kt(zeros, ones)
    children = {k[:depth + 1] for k in counts if k[:depth] == context}
    return 0.5 * kt(zeros, ones) + 0.5 * math.prod(weighted(counts, c, depth + 1) for c in children)


def slow_byte(train, context, byte):
    """Probability of a byte by adding each of its decisions to the trees and taking the ratio."""
    trees = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for c, b in train:
        for level in range(8):
            trees[(1 << level) | (b >> (8 - level))][c][b >> (7 - level) & 1] += 1
    chance = 1.0
    for level in range(8):
        tree = {k: list(v) for k, v in trees[(1 << level) | (byte >> (8 - level))].items()}
        before = weighted(tree, (), 0)
        tree.setdefault(context, [0, 0])[byte >> (7 - level) & 1] += 1
        chance *= weighted(tree, (), 0) / before
    return chance


def events(text):
    line = [ctw.EDGE] * ctw.DEPTH + list(text.encode().lower()) + [ctw.EDGE]
    return [(tuple(reversed(line[i - ctw.DEPTH:i])), line[i]) for i in range(ctw.DEPTH, len(line))]


def code_of(context, byte):
    return int.from_bytes(bytes(context) + bytes([byte]), "big")


def test_codes():
    given_texts = ["", "Ab\n", "é", "abcdefgh"]
    code, owner = ctw.codes(next(texts.pieces(pa.array(given_texts))))
    want = [(i, code_of(c, b)) for i, t in enumerate(given_texts) for c, b in events(t)]
    assert list(zip(owner.tolist(), code.tolist())) == want


def test_tree_equals_definition():
    train = [e for t in ("abab", "abac b", "aab") for e in events(t)]
    asked = [e for t in ("abab", "abc", "zz") for e in events(t)]
    counts = Counter(code_of(*e) for e in train)
    grams = np.array(sorted({code_of(*e) for e in train + asked}), dtype=np.uint64)
    ladder = ctw.Ladder(grams, np.array([counts[int(g)] for g in grams]), 2)
    parts = [np.zeros(256 * 256) for _ in range(3)]
    for level in range(8):
        cells = ctw.cells_of(ladder, level)[-1]
        rows = ladder.rows[-1][cells.first]
        place = (rows >> np.uint64(16)).astype(int) * 256 + ctw.node_of(rows, level)
        for total, value in zip(parts, (cells.zeros, cells.ones, cells.weighted)):
            np.add.at(total, place, value)
    near, node = np.divmod(np.arange(256 * 256), 256)
    found = ctw.log_probability(ladder, ctw.Top(near, node, *parts))
    for e in set(asked):
        want = math.log(slow_byte(train, *e))
        assert found[np.searchsorted(grams, np.uint64(code_of(*e)))] == pytest.approx(want, abs=1e-9)


def test_packing():
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    assert (ctw.unpack(ctw.pack(values), 1000) == values).all()
    assert (ctw.unpack_sorted(ctw.pack_sorted(values), 1000) == values).all()
    words = pa.array(["a", "é", "xyz"], pa.large_string())
    length = len("a é xyz ".encode())
    assert ctw.unpack_words(ctw.pack_words(words), length) == ["a", "é", "xyz"]
    assert (ctw._word_hash(words) == ctw._word_hash(words.take(pa.array([0, 1, 2])))).all()


# Segmentation -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.Vocabulary.load()


def all_ways(vocabulary, text):
    known = {int(k): int(i) for k, i in zip(vocabulary.keys, vocabulary.found) if k and i >= 0}

    def ways(rest):
        if not rest:
            yield (), 0.0
        for size in range(1, len(rest) + 1):
            i = known.get(segmentation._hash(rest[:size]))
            if i is not None:
                for more, chance in ways(rest[size:]):
                    yield (i, *more), chance + vocabulary.log_probability[i]

    found = dict(ways(text))
    total = sum(map(math.exp, found.values()))
    return {k: math.exp(v) / total for k, v in found.items()}


@pytest.mark.parametrize("word", ["other", "tion", "unseen"])
def test_sampling_follows_the_lattice(vocabulary, word):
    want, draws = all_ways(vocabulary, " " + word), 20000
    ids, chance = segmentation.encode(vocabulary, pa.array([word] * draws), np.arange(draws))
    seen = Counter(map(tuple, ids.to_pylist()))
    assert set(seen) <= set(want)
    for way, share in want.items():
        assert abs(seen[way] / draws - share) < 4 * math.sqrt(share * (1 - share) / draws) + 1e-3
    for way, log_chance in list(zip(ids.to_pylist(), chance))[:200]:
        assert math.exp(log_chance) == pytest.approx(want[tuple(way)], rel=1e-6)


@given(st.lists(st.one_of(st.text(max_size=30), WORDY), max_size=8), st.integers(0, 2 ** 40))
@settings(max_examples=150, deadline=None)
def test_round_trip(vocabulary, given_texts, seed):
    given_texts = [t.encode("utf-8", "ignore").decode() for t in given_texts]
    seeds = np.arange(len(given_texts)) + seed
    ids, _ = segmentation.encode(vocabulary, pa.array(given_texts, pa.string()), seeds)
    assert segmentation.decode(vocabulary, ids).to_pylist() == given_texts
    for i in range(len(given_texts)):  # alone as in a batch
        one, _ = segmentation.encode(vocabulary, pa.array(given_texts[i:i + 1], pa.string()), seeds[i:i + 1])
        assert one.to_pylist()[0] == ids.to_pylist()[i]


def test_long_texts_round_trip(vocabulary):
    given_texts = [LONG, UNBROKEN, "", " " * 50]
    ids, _ = segmentation.encode(vocabulary, pa.array(given_texts), np.arange(4))
    assert segmentation.decode(vocabulary, ids).to_pylist() == given_texts


# Edit embedding ---------------------------------------------------------------------------------

def slow_print(text):
    chars = np.array([ord(c) for c in text], dtype=np.uint32)
    kind = editprint.kinds(chars)
    coins = (editprint._mixed(np.arange(editprint.KINDS * editprint.PERIOD, dtype=np.uint64) * editprint._GOLD) >> np.uint64(63))
    line, i = [], 0
    while i < len(text):
        j = len(line)
        line.append(i)
        i += int(coins[int(kind[i]) * editprint.PERIOD + j % editprint.PERIOD])
    places = editprint.PLACES[editprint.PLACES < len(line)]
    return editprint._symbols(chars[[line[p] for p in places]], np.arange(len(places))).tobytes() if len(line) else b""


def test_walks():
    rng = np.random.default_rng(0)
    given_texts = ["".join(rng.choice(list("abcdé "), int(n))) for n in rng.integers(0, 400, 150)] + ["", "a", "ab"]
    followers = given_texts[1:] + given_texts[:1]
    found, edited, changed = editprint.prints(given_texts, followers)
    assert found == [slow_print(t) for t in given_texts]
    assert changed == [t[:len(t) - len(t) // 3] + f[:len(t) // 3] for t, f in zip(given_texts, followers)]
    assert edited == [slow_print(t) for t in changed]


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(1)
    means = []
    for edits in (0, 1, 5, 40, 1000):
        found = []
        for _ in range(60):
            text = list(rng.choice(list("abcdefgh "), 2000))
            other = list(text)
            for at in rng.integers(0, 1900, edits):
                at %= len(other) - 1
                other[at] = "xy"[at % 2]
                del other[at + 1:at + 1 + at % 2]
            a, b = editprint.prints(["".join(text), "".join(other)])[0]
            found.append(editprint.likeness(a, b))
        means.append(np.mean(found))
    # A walk falls back into step some hundred characters after an edit, so one edit costs little of 2000.
    assert means[0] == 1.0 and all(a > b for a, b in zip(means, means[1:])) and means[1] > 0.8, means
    assert editprint.likeness(b"", b"") == 1.0 and editprint.likeness(b"", b"a") == 0.0
