"""The operators as queries over the corpus tables, with production parameters and whole results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, minhash, mixing, packing, simhash, substrings, suffixes, tokens, vectors
from .common import table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; GNEISS_TOKENIZERS names another folder."""
    folder = os.environ.get("GNEISS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = language.learn(docs.filter(~held_out))
    return language.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_substring_dedup, op3_best_fit_packing, op4_suffix_dedup, op5_mixing, op6_simhash, op7_language, op8_vectors, op9_line_dedup, op10_fingerprints)}


#: Two-line runs and lines of 50 words by their text, the earliest place of each, and the lines that later ones cover.
LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, s, 2 AS n, ls[s + 1] || chr(10) || ls[s + 2] AS k FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 1)) AS s FROM l)
  UNION ALL SELECT doc_id, s, 1, k FROM (SELECT doc_id, unnest(range(0, len(ls))) AS s, unnest(ls) AS k FROM l) WHERE len(regexp_extract_all(k, '[^\x20\x09-\x0D]+')) >= 50),
first AS (SELECT k, n, min((doc_id, s)) AS f FROM w GROUP BY k, n HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM w JOIN first USING (k, n) WHERE (doc_id, s) > f)),
listed AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: ls[i + 1]), chr(10)), '')) AS kept_sha256
FROM l LEFT JOIN listed USING (doc_id)
"""


WORDS = r"'[^\x20\x09-\x0D]+'"

#: Every window of 20 words by its text, the earliest place of each, and the words that later ones cover.
SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS s FROM d WHERE len(ws) >= 20)),
first AS (SELECT k, min((doc_id, s)) AS f FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM w JOIN first USING (k) WHERE (doc_id, s) > f)),
word AS (SELECT doc_id, i, ws[i + 1] AS t FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Shares by weight with the excess of full sources passed on, then probabilities in proportion to size, the documents of lowest rank that fit, and one that fits best.
MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, '')) || ':' || coalesce('=' || source, '-')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(source_size * {mixing.MOST_TIMES} AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM k WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cap, coalesce((SELECT level FROM l WHERE cap >= level * w ORDER BY cap / w, k LIMIT 1), 'inf'::DOUBLE) * w) END AS target FROM l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (SELECT *, target - whole * source_size AS need, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS p FROM n),
z AS (SELECT d.source, size, need, count(*) AS n FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE size > 0 GROUP BY ALL),
y AS (SELECT source, size, (need - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / CAST(sum(CAST(n AS HUGEINT) * size * size) OVER (PARTITION BY source ORDER BY size) AS DOUBLE) AS rate FROM z),
x AS (SELECT source, arg_max(rate, size) AS rate FROM y WHERE rate * size <= 1 GROUP BY source),
q AS (SELECT d.*, source_size, target, whole, need, least(1.0, coalesce(rate, 0) * size) AS p, row_number() OVER (PARTITION BY key) - 1 AS ordinal
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source),
u AS (SELECT *, (CAST('0x' || substr(md5(key || ':' || ordinal || ':17'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM q),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS rank FROM u),
c AS (SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, key, ordinal ROWS UNBOUNDED PRECEDING) <= need AS taken_in FROM r),
g AS (SELECT *, need - coalesce(sum(CASE WHEN taken_in THEN size END) OVER (PARTITION BY source), 0) AS gap FROM c),
o AS (SELECT *, min(CASE WHEN NOT taken_in AND rank IS NOT NULL AND abs(size - gap) < gap THEN (abs(size - gap), rank, key, ordinal) END) OVER (PARTITION BY source) AS closing FROM g)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN taken_in OR coalesce((abs(size - gap), rank, key, ordinal) = closing, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM o
"""

#: All pairs by their cosine in double precision, and what they reach.
VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {vectors.THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRINGS, "op5_mixing": MIXING, "op8_vectors": VECTORS, "op9_line_dedup": LINE_DEDUP}
