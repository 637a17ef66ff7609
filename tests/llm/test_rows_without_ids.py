"""Rows without an id are told apart by what they hold."""

from __future__ import annotations

import random

import brute
import pytest

from gneiss.llm import simhash, substrings, suffixes, vectors


def texts(n):
    rnd = random.Random(n)
    return [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(200)) for _ in range(n)]


def test_near_duplicates(spark):
    a, b, c, d = texts(4)
    rows = [(5, a), (None, a.upper()), (9, b), (None, b.upper()), (None, c), (None, c.upper()), (None, c), (None, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted([(5, 5), (9, 9), (None, 5), (None, 9), *[(None, None)] * 4], key=str)
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()]
    assert sorted(d for d, _ in kept if d) == [5, 9]
    unnamed = [t for i, t in kept if i is None]
    assert len(unnamed) == 2 and d in unnamed and {t.lower() for t in unnamed} == {c, d}


def test_vectors(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (None, [1.0, 0.1, 0.0]), (9, [0.0, 0.0, 1.0]), (None, [0.0, 0.1, 1.0]), (None, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).collect()]
    assert sorted(found, key=str) == sorted([(5, 1, 5), (None, 1, 5), (9, 1, 9), (None, 1, 9), (None, 0, None)], key=str)


@pytest.mark.parametrize("first", [1, (1 << 63) - 3])
def test_stretches(spark, first):
    a, b, c = texts(3)
    part = " ".join(a.split()[50:100])
    rows = [(first, a), (None, f"{part} {b}"), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.words(enumerate(t for _, t in rows))
    found = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.substring_dedup(df).collect())
    assert found == sorted((w[0], w[1], w[3]) for w in want.values())
    want = brute.strings(enumerate(t for _, t in rows))
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = suffixes.suffix_dedup(df).collect()
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(want.values())
    assert sorted(str(r["doc_id"]) for r in found) == sorted(["None", "None", str(first)])
