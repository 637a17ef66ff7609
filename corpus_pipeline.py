"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import language, lines, mixing, nearcopies, packing
from gneiss.llm.common import discard, keep, materialize, scratch, table
from gneiss.llm.queries import tokenizer_file

#: Share of the longest out-of-place distance by which a text must be nearer to some language. Measured: the poorest
#: text of the test tables' four languages has 0.386; random letters have 0.13 to 0.2 from 200 characters on (0.25 to
#: 0.31 in 20 characters), a script that no language has 0.
LEAST_SCORE = 0.3
#: Words whose token ids a worker remembers a generation. Fewer than op3 keeps: after four stages the executor holds more.
REMEMBERED = 250_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the documents' own labels teach.

    What is null or has no letter goes, and what is less like every profile than LEAST_SCORE: random strings and
    scripts of no learned language. Where nothing is labelled, every text with a letter stays. Rows come back as
    they were.
    """
    profiles = language.learn(docs)
    if not profiles:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.identify(docs, profiles, tuple(docs.columns), names=("__lang_pred", "__score"))
    return found.filter((F.col("__lang_pred") != language.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two lines, and the single lines of 50 words or more, that stand earlier; those of which nothing is left go."""
    found = lines.deduplicated(docs).filter("__n_removed < __n_lines")
    n_chars = F.when(F.col("__n_removed") > 0, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("__kept"), "n_chars": n_chars}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard index of 0.8 or more."""
    return nearcopies.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a document taken twice is two rows."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.best_fit_packing(docs, tokenizer_file("word_bpe_49k.json"), remember=REMEMBERED)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SimHash components and packing have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's input and working tables are deleted once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = keep(materialize(stage(spark, docs, sf_dir)))
        discard(spark, before)
        before = [docs._gneiss_path]
    return STAGES[-1][1](spark, docs, sf_dir)
