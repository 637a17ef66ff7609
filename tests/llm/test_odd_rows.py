"""Repeated rows, rows without an id, columns with clashing names, lone cells, very long texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import common, language, lines, mixing, simhash

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("starts", "score", "lang_pred", "covered", "runs", "doc", "text_key", "size", "target", "copies", "fp", "rank", "gap", "block", "component", "n_lines", "key", "place", "row", "rate", "kept", "cid", "node")


def odd(spark):
    """Clean texts, copies of some, nulls everywhere, repeated rows, and columns named like inner ones."""
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(80)) + "\nsecond line\nthird " + str(i) for i in range(12)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(None, t, None, None, None) for t in texts[:4]] + [(3, texts[3], "en", "a", 1)] * 3 + [(None, None, None, None, None)] * 2 + [(77, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_take_clashing_columns_and_odd_rows(spark, stage):
    docs = odd(spark)
    found = stage(spark, docs, "")
    assert found.columns == docs.columns
    assert 0 < found.count() <= 3 * docs.count()
    assert stage(spark, docs.limit(0), "").count() == 0


def test_equal_rows_share_the_mix(spark):
    """Targets, limits and nearness as the contract has them, where rows repeat and ids are missing."""
    rows = [(None, "a b c d", "x")] * 400 + [(i % 4, "q w e r", "y") for i in range(400)] + [(1000 + i, "one two", "z") for i in range(50)]
    found = mixing.mix_to_weights(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(found) == len(rows) and all(abs(taken[s] - target[s]) <= 4 for s in target)


def test_longer_documents_have_better_odds(spark):
    """Sampled without whole copies, probabilities grow with size, and the longest are certain."""
    rnd = random.Random(5)
    sizes = [rnd.randrange(1, 60) for _ in range(3000)] + [4000]
    rows = [(i, "w " * n, "a") for i, n in enumerate(sizes)] + [(9000, "w " * 100_000, "b"), (9001, "w " * 10, "c")]
    found = [r for r in mixing.mix_to_weights(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 5, 2)).collect() if r["source"] == "a"]
    assert 0 < found[0]["target"] < found[0]["source_size"]
    share = lambda lo, hi: np.mean([r["copies"] for r in found if lo <= r["size"] < hi])
    assert share(40, 60) > 1.3 * share(20, 40) > 1.3 * share(1, 20) and share(4000, 4001) == 1
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 2


def test_languages_of_copied_rows_are_learned(spark):
    german = "der hund und die katze laufen über die straße"
    rows = [(None, german, "de")] * 20_000 + [(i, "the dog and the cat walk over the road", "en") for i in range(50)]
    profiles = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    assert set(profiles) == {"de", "en"}


def test_long_texts_are_counted_in_parts():
    text = "Hällo wörld ... 12 abc漢字  x" * 50
    data = memoryview(np.frombuffer(text.encode(), np.uint8))
    keys, _ = language.grams(pa.array([text]))
    values, counts = np.unique(keys, return_counts=True)
    for step in (1, 7, 100, 10**6):
        found = language.counted(data, step)
        assert (found[0] == values).all() and (found[1] == counts).all()


def test_lone_cells_and_many_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, ("64", "false", "2"), strict=True):
            spark.conf.set(k, v)
        df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e", "a b c d e", "z y x"] * 3)], "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {i: 2 if i % 3 == 2 else 0 for i in range(9)}
        found = {r["doc_id"]: r["__n_removed"] for r in lines.deduplicated(df).collect()}
        assert set(found.values()) == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_text_of_many_megabytes_without_spaces(spark):
    text = "漢" * 2_000_000
    df = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source", "0L n_chars")
    assert {r["doc_id"]: r["size"] for r in mixing.mix_to_weights(df).collect()} == {1: 1, 2: 2}
    assert {r["doc_id"] for r in language.identify(df, language.learn(df)).collect()} == {1, 2}
    assert lines.deduplicated(df).count() == 2


def test_no_local_folder_outside_local_masters(spark, monkeypatch, tmp_path):
    class Context:
        master = "spark://far"

        class _jsc:
            @staticmethod
            def sc():
                class Named:
                    def isDefined(self):
                        return bool(Context.folder)

                    def get(self):
                        return Context.folder

                class Scala:
                    def getCheckpointDir(self):
                        return Named()

                return Scala()

        folder = None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Context.folder = "hdfs://shared/"
    assert common.shared_dir(Session) == "hdfs://shared"


def test_tables_are_deleted_when_read(spark):
    df = spark.range(5)
    with common.scratch(spark):
        gone = common.materialize(df)
        with common.scratch(spark):
            kept = common.keep(common.materialize(df))
        assert kept.count() == 5
        last = common.keep(common.materialize(kept))
    assert last.count() == 5
    import os

    assert not os.path.exists(gone._gneiss_path.removeprefix("file://")) and not os.path.exists(kept._gneiss_path.removeprefix("file://"))
