"""Tokenizer alignment against a plain version over all pairs of tokens."""

from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import alignment, queries
from tests.llm.edges import documents, nothing

SMALL = "/root/testdata/sf0.001"


def spans_of(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(rows):
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    letters = alignment.byte_letters()
    held, docs = [], Counter()
    for key, text in rows:
        text = text or ""
        ids = a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(letters[c] for c in t)) for i, t in zip(ids.ids, ids.tokens)] if text else []
        other = [(i, alignment.piece_bytes(b.id_to_piece(i))) for i in b.encode(text)]
        whole = (" " + text).encode()
        if not text or not b"".join(p for _, p in one) == whole == b"".join(p for _, p in other):
            one = other = []
        x, y = spans_of([p for _, p in one]), spans_of([p for _, p in other])
        links, first = [], 0
        for (i, _), (lo, hi) in zip(one, x):
            while first < len(y) and y[first][1] <= lo:
                first += 1
            k = first
            while k < len(y) and y[k][0] < hi:
                links.append((i, other[k][0]))
                k += 1
        cuts = sorted({e for _, e in x} & {e for _, e in y})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for (i, _), (s, e) in zip(one, x) if low <= s and e <= cut) + "|"
                          + ",".join(str(i) for (i, _), (s, e) in zip(other, y) if low <= s and e <= cut))
            low = cut
        docs.update(set(links))
        held.append((key, len(one), len(other), groups, links))
    most = defaultdict(int)
    for (i, _), n in docs.items():
        most[i] = max(most[i], n)
    return Counter((key, n_a, n_b, len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links),
                    sha256(";".join(groups).encode()).hexdigest() if n_a else "") for key, n_a, n_b, groups, links in held)


def got(frame):
    return Counter(tuple(r[c] for c in ("doc_id", *alignment.RESULTS)) for r in alignment.alignments(frame).collect())


def short(rows):
    return [r for r in rows if r[1] is None or len(r[1]) < 3000]


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 500])
def test_equals_plain(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = short(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain(rows)


def test_odd_texts(spark):
    texts = ["<|endoftext|> in a text", "<s> and </s>, <unk>", "a▁b", "▁", " ", "  two  blanks ", "\n\n", "\t", "é😀日本語", "\u0000x",
             "don't   stop!!!", "naïve Ünïcödé", "ﬁ ligature", "ａｂｃ", "é", " x", "\r\nx", "<0x41>", "a" * 500, "�"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "same")] * 40
    want = plain(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert {r[0] for r in want if r[1] == 0} >= {2, 3}


def test_edges(spark):
    docs = documents(spark).filter("text is null or length(text) < 3000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    odd = docs.withColumn("place", docs["text"]).withColumn("block", docs["size"]).withColumn("key", docs["lang"])
    assert got(odd) == plain(rows) and got(nothing(spark)) == Counter()
    assert alignment.alignments(documents(spark)).count() == documents(spark).count()


def test_links_and_groups_add_up(spark):
    for r in queries.op12_alignment(spark, SMALL).collect():
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_best"] <= r["n_links"] <= r["count_sum"]
