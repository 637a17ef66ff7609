"""Single long lines that repeat, against a plain replay."""

from __future__ import annotations

import corpus_pipeline
from gneiss.llm import lines

SMALL = "/root/testdata/sf0.01"


def replay(docs):
    """id -> text that is left (None if nothing is), by the two-line rule and that for lines of 50 words."""
    first, out = {}, {}
    for d, text in sorted(docs):
        ls, gone = (text or "").split("\n"), set()
        for i in range(len(ls)):
            if i + 1 < len(ls) and first.setdefault((ls[i], ls[i + 1]), (d, i)) != (d, i):
                gone |= {i, i + 1}
            if len(ls[i].encode().split()) >= 50 and first.setdefault(ls[i], (d, i)) != (d, i):
                gone.add(i)
        out[d] = None if len(gone) == len(ls) else "\n".join(x for i, x in enumerate(ls) if i not in gone) if gone else text
    return out


def check(spark, df, rows):
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    want = {d: t for d, t in replay(rows).items() if t is not None or dict(rows)[d] is None}
    assert found == want


def test_long_lines_between_unlike_neighbours(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    rows = [(0, None), (1, long), (2, long), (3, f"a\n{long}\nb"), (4, f"c\n{long}\nd\n{long}"), (5, short), (6, short), (7, f"x\n{short}\ny"), (8, f"a\n{long}\nb"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(length(text) as bigint) n_chars")
    assert replay(rows)[3] == "a\nb" and replay(rows)[2] is None
    check(spark, df, rows)


def test_long_lines_of_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    plain = sum(r["__n_removed"] for r in lines.deduplicated(df, long=None).collect())
    assert sum(r["__n_removed"] for r in lines.deduplicated(df).collect()) > plain
    check(spark, df, rows)
