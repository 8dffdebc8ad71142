"""Near copies by shingle sets against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import shingles
from tests.llm.edges import words


def plain_set(text, width=5):
    held = words(text)
    return {tuple(held[i:i + width]) for i in range(max(1, len(held) - width + 1))} if held else set()


def kept_by_all_pairs(texts):
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return set(label)


def near_copies(rng):
    """Texts with copies of likeness about 0.7 to 0.97, chains of copies and short texts."""
    made = []
    for _ in range(30):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 120, 400]))]
        made.append(text)
        for _ in range(6):
            near = list(rng.choice([made[-1], text]))
            for _ in range(rng.randrange(1, 2 + len(text) // 60)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(5000)}"
            made.append(near)
    made += [[w] for w in ("one", "two", "one", "One")] + [[], []]
    rng.shuffle(made)
    return [" ".join(t) for t in made]


@pytest.mark.parametrize("part", [shingles.PART, 1500])  # the second cuts groups into parts
def test_one_of_each_equals_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(shingles, "PART", part)
    texts = near_copies(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == kept_by_all_pairs(texts) and len(got) == len({r["doc_id"] for r in got})


def test_band_recall():
    rng, found, pairs = random.Random(6), 0, 0
    for _ in range(400):
        text = [f"w{rng.randrange(10000)}" for _ in range(300)]
        near = list(text)
        for _ in range(6):
            near[rng.randrange(300)] = "other"
        a, b = plain_set(" ".join(text)), plain_set(" ".join(near))
        if len(a & b) >= 0.8 * len(a | b):
            one, two = (shingles.band_keys(s) for s in shingles.shingle_sets(shingles.pa.array([" ".join(text), " ".join(near)])))
            pairs, found = pairs + 1, found + bool(set(one.tolist()) & set(two.tolist()))
    assert pairs > 100 and found >= 0.995 * pairs


def test_simhash_gives_candidates(spark, monkeypatch):
    """Without the other keys, near sets are found if and only if their fingerprints are linked."""
    monkeypatch.setattr(shingles, "band_keys", lambda held: np.zeros(0, np.int64))
    rng, texts = random.Random(8), []
    for _ in range(24):
        text = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
        texts += [" ".join(text), " ".join([*text[:399], "other"])]
    prints = [shingles.majority(held) for held in shingles.shingle_sets(shingles.pa.array(texts))]
    near = [((a ^ b) & (2 ** 64 - 1)).bit_count() <= shingles.DISTANCE for a, b in zip(prints[::2], prints[1::2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert sum(near) > 12 and got == {i for i in range(48) if i % 2 == 0 or not near[i // 2]}


def test_rows_that_surely_stay_do_not_move(spark, monkeypatch):
    moved, real = {}, shingles.marked
    monkeypatch.setattr(shingles, "marked", lambda rows, hashed, some, flag: moved.setdefault(flag, real(rows, hashed, some, flag)))
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(300)]
    texts += [texts[0], texts[1] + " more", "", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == kept_by_all_pairs(texts)
    assert {flag: frame.filter(flag).count() for flag, frame in moved.items()} == {"held": 2, "_unsure": 3}
