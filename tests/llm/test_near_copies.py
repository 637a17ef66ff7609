"""The pipeline's near-copy stage against brute-force Jaccard."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest

from gneiss.llm import nearcopies

SMALL = "/root/testdata/sf0.01"


def grams(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def kept(rows):
    """ids that stay, by all pairs."""
    sets = {d: grams(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {d for d, c in brute.reach(ids, links).items() if d == c}


def edited(rnd, share):
    """A text and a copy with a share of single words changed."""
    base = [f"u{rnd.randrange(10**6)}" for _ in range(300)]
    other = list(base)
    for i in rnd.sample(range(300), int(300 * share)):
        other[i] = "changed"
    return " ".join(base), " ".join(other)


@pytest.mark.parametrize("group", [nearcopies.GROUP_ROWS, 3])
def test_stage_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(nearcopies.verified, "__defaults__", (group,))
    rnd = random.Random(1)
    texts = [t for share in (0.01, 0.02, 0.03, 0.06) for _ in range(8) for t in edited(rnd, share)]
    base, _ = edited(rnd, 0)
    texts += [base.replace("u1", f"v{i}", 2) for i in range(12)] + [None, "", " ", "a b", "A b", base.upper()]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    assert len(want) < len(rows) - 30
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()} == want


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 400")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == kept(rows)


def test_rows_without_an_id(spark):
    rnd = random.Random(2)
    (a, near_a), (b, near_b), (c, near_c) = (edited(rnd, 0.02) for _ in range(3))
    rows = [(5, a), (None, near_a), (9, b), (None, near_b), (None, c), (None, c), (None, near_c), (None, "alone and near nothing at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()]
    assert sorted(d for d, _ in left if d) == [5, 9]
    unnamed = [t for d, t in left if d is None]
    assert len(unnamed) == 2 and rows[-1][1] in unnamed and (c in unnamed) != (near_c in unnamed)
