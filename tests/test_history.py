"""Churn, co-change, ownership, hotspots and commit blocks on small histories."""

from pyspark.sql import functions as F

from gneiss.operators import history


def commits(spark, *rows):
    """Rows of (author, files) as one listing each."""
    return history.explode_commits(spark.createDataFrame([(i, a, list(f)) for i, (a, f) in enumerate(rows)], "commit long, author string, files array<string>"))


def table(df, key="file"):
    return {r[key]: r for r in df.collect()}


def test_churn_counts_listings(spark):
    assert {k: r["churn"] for k, r in table(history.churn(commits(spark, ("a", "AB"), ("a", "A"), ("b", "BC")))).items()} == {"A": 2, "B": 2, "C": 1}
    assert history.churn(commits(spark).limit(0)).count() == 0


def test_cochange_threshold_order_and_symmetry(spark):
    rows = commits(spark, ("a", "ABC"), ("a", "AC"), ("a", "AC"), ("a", "AB"))
    partners = {k: [(p["file"], p["frequency"]) for p in r["partners"]] for k, r in table(history.cochange_partners(history.cochange_pairs(rows, 1))).items()}
    assert partners["A"] == [("C", 3), ("B", 2)]
    assert history.cochange_pairs(rows, 5).count() == 0
    pairs = {(r["file"], r["partner"], r["frequency"]) for r in history.cochange_pairs(rows, 1).collect()}
    assert pairs == {(b, a, n) for a, b, n in pairs}
    assert history.cochange_pairs(commits(spark, ("a", "A"), ("a", "A")), 1).count() == 0


def test_owner_is_most_frequent_author_and_blank_ones_do_not_count(spark):
    owned = table(history.ownership(commits(spark, ("", "A"), ("  ", "A"), ("alice", "AB"), ("bob", "BC"), ("bob", "B"))))
    assert {k: r["owner"] for k, r in owned.items()} == {"A": "alice", "B": "bob", "C": "bob"}


def test_ownership_tie_goes_to_the_smaller_name(spark):
    assert history.ownership(commits(spark, ("zoe", "A"), ("amy", "A"))).first()["owner"] == "amy"


def test_hotspots_with_and_without_zero_scores(spark):
    churned = spark.createDataFrame([("A", 3), ("B", 2)], "file string, churn long")
    coupled = spark.createDataFrame([("A", 2), ("C", 4)], "file string, coupling long")
    assert [(r["file"], r["score"]) for r in history.hotspots(churned, coupled).collect()] == [("A", 6), ("B", 0), ("C", 0)]
    assert [r["file"] for r in history.hotspots(churned, coupled, zero_scores=False).collect()] == ["A"]
    assert history.hotspots(churned, coupled, top=1).count() == 1


def test_coupling_skips_dangling_blank_and_own_file(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "b2"), ("x", "b"), ("c", "b"), ("d", "b")], "from_id string, to_id string")
    files = spark.createDataFrame([("a", "A"), ("b", "B"), ("b2", "B"), ("c", "C"), ("d", " ")], "id string, file string")
    assert [(r["file"], r["coupling"]) for r in history.coupling(edges, files).collect()] == [("B", 2)]


def test_blocks_drop_commits_without_files(spark):
    lines = spark.createDataFrame([(1, "COMMIT:a"), (2, " f "), (3, ""), (4, "COMMIT:b"), (5, "COMMIT:c"), (6, "g"), (7, "h")], "n long, line string")
    found = history.commit_blocks(lines, F.col("line").startswith("COMMIT:"), "n").orderBy("block").collect()
    assert [(r["header"], r["files"]) for r in found] == [("COMMIT:a", ["f"]), ("COMMIT:c", ["g", "h"])]
