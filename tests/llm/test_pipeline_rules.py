"""The pipeline against a brute-force one that states its stages' own rules.

Runs of two lines and single lines of 50 words go where they stand earlier; near copies share four fifths of their
five-word shingles; pieces are the tokenizer library's. What the language stage keeps is taken as it is.
"""

from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
from test_near_copies import kept

from gneiss.llm import mixing, queries, tokens

SMALL = "/root/testdata/sf0.001"
LONG_LINE = 50


def test_pipeline_follows_its_rules(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, table, SMALL).select("doc_id").collect()}
    assert {d for d, r in docs.items() if r["text"] and r["lang"] and any(c.isalpha() for c in r["text"])} <= left
    first, texts = {}, {}
    for d in sorted(left):
        lines, gone = docs[d]["text"].split("\n"), set()
        runs = [(i, 2) for i in range(len(lines) - 1)] + [(i, 1) for i, x in enumerate(lines) if len(x.split()) >= LONG_LINE]
        for i, n in sorted(runs):
            if first.setdefault(tuple(lines[i : i + n]), (d, i)) != (d, i):
                gone |= set(range(i, i + n))
        if len(gone) < len(lines):
            texts[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert sum(texts[d] != docs[d]["text"] for d in texts) > 0
    single = {d: texts[d] for d in kept(sorted(texts.items()))}
    rows = spark.createDataFrame([(d, t, docs[d]["source"]) for d, t in single.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_to_weights(rows).collect()}
    want = Counter()
    for (d, piece), value in brute.pieces(sorted(single.items()), tokens.tokenizer(queries.tokenizer_file("word_bpe_49k.json"))).items():
        if copies[d]:
            want[(d, piece, *value)] = copies[d]
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    at = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096
