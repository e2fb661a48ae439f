"""The corpus pipeline: language, lines, near duplicates, mixture, tokens.

Every stage works on all that its predecessor kept, and is written as Parquet
before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import bpe, langid, linededup, mixing, setjoin
from loomstone.llm.scratch import bounded, cut, quoted

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or no letter); a missing label becomes the prediction."""
    bounded(spark)
    found = langid.identify(docs, langid.fit(docs, F.lit(True)), "__pred", "__score")
    lang = F.coalesce("lang", F.col("__pred")).alias("lang")
    return found.where(F.col("__pred") != langid.UNDETERMINED).select(*[lang if c == "lang" else quoted(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each class of near-equal lines. Documents stay, also those left without a line."""
    bounded(spark)
    return linededup.dedup(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the one with the smallest doc_id; of rows that repeat doc_id and text, one.

    Rows that repeat a doc_id with other texts are documents of their own.
    """
    bounded(spark)
    return setjoin.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix takes them; the part of a last repetition is the document's first words."""
    bounded(spark)
    return mixing.apply(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decodes``: packed ids, and whether they decode to the text."""
    bounded(spark)
    both = bpe.verified(docs.select("doc_id", "lang", "source", "text"))
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decodes")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: SQL expresses neither fuzzy lines nor token ids: the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
