"""Tokens and BM25 as column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in ASCII lower case; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def query_terms(text: str) -> list[str]:
    """Tokens of a query string, repeats included."""
    return [t.lower() for t in re.findall(r"[A-Za-z0-9]+", text)]


def document(columns: Sequence[str]) -> Column:
    """The text that is scored: the columns joined by one space. A row without them is an empty document."""
    return F.concat_ws(" ", *[F.col(c) for c in columns]) if len(columns) > 1 else F.coalesce(F.col(columns[0]), F.lit(""))


#: Stands between two tokens of ``spaced``, and at both ends.
GAP = "  "


def spaced(text: Column) -> Column:
    """The tokens in lower case, two spaces before, between and after them: a term is ``' term '`` wherever it occurs.

    One regular expression pass, whose result holds ASCII alone; all that
    follows are plain string functions.
    """
    return F.concat(F.lit(GAP), F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", GAP)), F.lit(GAP))


def occurrences(spaced_text: Column, term: str) -> Column:
    """How often a token occurs in ``spaced`` text."""
    less = F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(f" {term} "), F.lit("")))
    return (less / (len(term) + 2)).cast("int")


def token_count(spaced_text: Column) -> Column:
    """Number of tokens of ``spaced`` text."""
    bare = F.trim(spaced_text)
    return F.when(F.length(bare) == 0, 0).otherwise((F.length(bare) - F.length(F.replace(bare, F.lit(GAP), F.lit("")))) / 2 + 1).cast("int")


def counted(rows: DataFrame, columns: Sequence[str], terms: Sequence[str], keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """``keep`` columns, ``dl`` (tokens) and ``tf``: how often each distinct query term occurs, as an array.

    Tokens exist within one projection only; no token is shuffled.
    """
    distinct = list(dict.fromkeys(terms))
    with_text = rows.select(*keep, spaced(document(columns)).alias("spaced"))
    tf = F.array(*[occurrences(F.col("spaced"), term) for term in distinct]) if distinct else F.array().cast("array<int>")
    return with_text.select(*keep, token_count(F.col("spaced")).alias("dl"), tf.alias("tf"))


def corpus(counts: DataFrame, terms: int) -> DataFrame:
    """One row over the whole corpus: ``n``, ``avgdl`` and ``df`` per term."""
    df = [F.sum(F.when(F.col("tf")[i] > 0, 1).otherwise(0)) for i in range(terms)]
    return counts.agg(
        F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"),
        (F.array(*[F.coalesce(d, F.lit(0)) for d in df]) if df else F.array().cast("array<bigint>")).alias("df"),
    )


def bm25(rows: DataFrame, columns: Sequence[str], text: str, keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """``keep`` and ``score`` of every row of ``rows`` that holds a query term.

    The corpus is ``rows`` itself, empty documents included, so filters change
    the scores. Terms repeated in the query count each time. Terms are added in
    query order, so equal inputs give equal doubles.
    """
    terms = query_terms(text)
    counts = counted(rows, columns, terms, keep)
    stats = F.broadcast(corpus(counts, len(dict.fromkeys(terms))))  # one row
    matching = counts.where(F.exists("tf", lambda x: x > 0)) if terms else counts.where("false")
    return matching.join(stats).select(*keep, weight(terms).alias("score")).where("score > 0")


def weight(terms: Sequence[str]) -> Column:
    """BM25 from ``tf, dl`` and the corpus' ``n, avgdl, df``: terms are added in query order, repeats each time."""
    distinct = list(dict.fromkeys(terms))
    total = F.lit(0.0)
    for term in terms:
        i = distinct.index(term)
        df, tf = F.col("df")[i].cast("double"), F.col("tf")[i].cast("double")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        norm = tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0)))
        total = total + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
    return total


def postings(rows: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """``keep, term, tf, dl`` of every token of every row, and one row with a null term for a row without tokens.

    The prepared form of a corpus: written once, it answers any query by its
    few terms' rows alone. Tokens are counted within a row before anything moves.
    """
    toks = tokens(document(columns))
    lists = rows.select(*keep, toks.alias("toks")).select(*keep, F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
    return lists.groupBy(*keep, "dl", "term").agg(F.count("term").alias("tf"))


def prepared(index: DataFrame, text: str, keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """``keep`` and ``score`` as ``bm25`` gives them, from written ``postings`` of the whole corpus.

    Only the query's terms are read of the postings; the corpus' size and mean
    length come from one narrow scan of them.
    """
    terms = query_terms(text)
    distinct = list(dict.fromkeys(terms))
    docs = index.select(*keep, "dl").distinct()
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    own = index.where(F.col("term").isin(*distinct)) if distinct else index.where("false")
    tf = F.array(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)) for t in distinct]) if distinct else F.array().cast("array<bigint>")
    matching = own.groupBy(*keep, "dl").agg(tf.alias("tf"))
    df = F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(distinct))]) if distinct else F.array().cast("array<bigint>")
    stats = size.join(F.broadcast(matching.agg(df.alias("df"))))
    return matching.join(F.broadcast(stats)).select(*keep, weight(terms).alias("score")).where("score > 0")


def repeated(text: str) -> Counter[str]:
    """How often each term of a query counts."""
    return Counter(query_terms(text))
