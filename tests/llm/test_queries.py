"""The registered queries over the small tables, and the pipeline against a brute-force one."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import brute
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import differs

import corpus_pipeline
from gneiss.llm import mixing, queries, tokens

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differs(spark, SMALL, queries.queries()[name], queries.oracle_sql()[name]) is None


def test_held_out_languages(spark):
    truth = documents(spark)
    rows = queries.op7_language(spark, SMALL).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 0 < len(held) < len(rows)
    assert sum(truth[r["doc_id"]]["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_pipeline_equals_brute_force(spark):
    docs = documents(spark)
    kept = {d: r["text"] for d, r in docs.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    # Lines.
    first, lines = {}, {}
    for d in sorted(kept):
        ls = kept[d].split("\n")
        gone = set()
        for i in range(len(ls) - 1):
            if first.setdefault(tuple(ls[i : i + 2]), (d, i)) != (d, i):
                gone |= {i, i + 1}
        if len(gone) < len(ls):
            lines[d] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    near = brute.near_texts(sorted(lines.items()))
    single = {d: t for d, t in lines.items() if near[d][1] == d}
    rows = spark.createDataFrame([(d, t, docs[d]["source"]) for d, t in single.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_to_weights(rows).collect()}
    library = tokens.tokenizer(queries.tokenizer_file("word_bpe_49k.json"))
    want = Counter()
    for (d, piece), value in brute.pieces(sorted(single.items()), library).items():
        if copies[d]:
            want[(d, piece, *value)] = copies[d]
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    at = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
