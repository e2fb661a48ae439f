"""Ranked candidate streams: ``record_id, score, penalty, rank``, at most a budget of rows each."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as text_fn
from loomstone.functions import values
from loomstone.functions import vector as vector_fn
from loomstone.model import HybridQuery, TableSpec

#: Scores of the streams that do not measure.
GRAPH_SCORE, TEMPORAL_SCORE, FALLBACK_SCORE = 0.6, 0.65, 1.0
#: Decimals that scores carry: ranks do not hang on the last bits.
DECIMALS = 6


class StreamProvider(Protocol):
    """Extension point: opens one more evidence stream over the visible rows, or none."""

    name: str

    def open(self, view: DataFrame, spec: TableSpec, query: HybridQuery, budget: int) -> DataFrame | None: ...


def ranked(rows: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` best rows with their rank: score falling, ties by record_id. Only they reach the ranking task."""
    best = rows.orderBy(F.col("score").desc(), "record_id").limit(budget)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "record_id")))


def _constant(rows: DataFrame, score: float) -> DataFrame:
    return rows.select("record_id", F.lit(score).alias("score"), F.lit(0.0).alias("penalty"))


def lexical(view: DataFrame, spec: TableSpec, query: HybridQuery, budget: int) -> DataFrame:
    """Rows that hold a query term, by BM25 over the visible rows."""
    scored = text_fn.bm25(view, spec.text_columns(query.text_field), query.text or "")
    return ranked(scored.select("record_id", F.round("score", DECIMALS).alias("score"), F.lit(0.0).alias("penalty")), budget)


def vector_score(column: Column, status: Column, query: HybridQuery) -> tuple[Column, Column]:
    """Score less penalty, and the penalty; null where the vector may not be scored."""
    off = vector_fn.penalty(status, query.freshness)
    cosine = F.round(vector_fn.cosine(column, query.vector or ()), DECIMALS)
    return F.when(~F.isnan(cosine), F.round(cosine - off, DECIMALS)), off


def vector(view: DataFrame, spec: TableSpec, query: HybridQuery, budget: int) -> DataFrame:
    """Rows with a usable vector, by cosine less the freshness penalty."""
    name = spec.vector(query.vector_field).name
    score, off = vector_score(F.col(name), F.col("feature_status")[name], query)
    return ranked(view.select("record_id", score.alias("score"), off.alias("penalty")).where("score is not null"), budget)


def graph(view: DataFrame, spec: TableSpec, query: HybridQuery, budget: int) -> DataFrame:
    """Rows whose edges name the seed."""
    return ranked(_constant(view.where(F.array_contains("edges", query.graph_seed)), GRAPH_SCORE), budget)


def temporal(view: DataFrame, spec: TableSpec, query: HybridQuery, budget: int) -> DataFrame:
    """Rows whose validity holds the asked epoch."""
    at = F.lit(query.temporal_as_of)
    return ranked(_constant(view.where(values.contains_epoch(F.col("valid_from"), F.col("valid_to"), at)), TEMPORAL_SCORE), budget)


def fallback(view: DataFrame, budget: int) -> DataFrame:
    """The first visible rows by record_id: the rank that policy, relational and hot-overlay candidates share."""
    return ranked(_constant(view, FALLBACK_SCORE), budget)


def narrow(view: DataFrame, spec: TableSpec, query: HybridQuery) -> DataFrame:
    """``record_id, nums`` of every visible row: all that the query's streams need of it, computed once.

    ``nums`` holds the document length and term counts, the vector score and its
    penalty, and whether the graph seed and the validity match. Every stream
    reads both columns whole from one exchange by record_id, so Spark plans the
    view, with its joins and its text, a single time.
    """
    terms = list(dict.fromkeys(text_fn.query_terms(query.text or ""))) if query.has_text else []
    # Matching is by identity of the plan, and a plan whose columns are pruned per stream is another one: hence one array.
    none = F.lit(None).cast("double")
    nums: list[Column] = []
    if query.has_text:
        spaced = text_fn.spaced(text_fn.document(spec.text_columns(query.text_field)))
        nums += [text_fn.token_count(spaced).cast("double"), *[text_fn.occurrences(spaced, t).cast("double") for t in terms]]
    if query.vector is not None:
        name = spec.vector(query.vector_field).name
        score, off = vector_score(F.col(name), F.col("feature_status")[name], query)
        nums += [score, off]
    if query.graph_seed is not None:
        nums.append(F.when(F.array_contains("edges", query.graph_seed), F.lit(GRAPH_SCORE)).otherwise(none))
    if query.temporal_as_of is not None:
        at = F.lit(query.temporal_as_of)
        nums.append(F.when(values.contains_epoch(F.col("valid_from"), F.col("valid_to"), at), F.lit(TEMPORAL_SCORE)).otherwise(none))
    packed = F.array(*[n.cast("double") for n in nums]) if nums else F.array().cast("array<double>")
    return view.select("record_id", packed.alias("nums")).repartition("record_id")


def opened(rows: DataFrame, query: HybridQuery, budget: int) -> dict[str, DataFrame]:
    """The query's evidence streams over ``narrow`` rows."""
    out: dict[str, DataFrame] = {}
    at, zero = 0, F.lit(0.0)

    def num(i: int) -> Column:
        return F.element_at("nums", i + 1)

    if query.has_text:
        terms = text_fn.query_terms(query.text or "")
        distinct = list(dict.fromkeys(terms))
        n = len(distinct)
        df = [F.coalesce(F.sum(F.when(num(1 + i) > 0, 1).otherwise(0)), F.lit(0)) for i in range(n)]
        stats = rows.agg(F.count("record_id").alias("n"), F.coalesce(F.avg(num(0)), zero).alias("avgdl"), (F.array(*df) if n else F.array().cast("array<bigint>")).alias("df"))
        counts = rows.select("record_id", num(0).alias("dl"), F.slice("nums", 2, max(1, n)).alias("tf"))
        score = text_fn.weight(terms)
        scored = counts.join(F.broadcast(stats)).select("record_id", F.when(score > 0, F.round(score, DECIMALS)).alias("score"), zero.alias("penalty"))
        out["lexical"] = _ranked_some(scored, budget)
        at = 1 + n
    if query.vector is not None:
        out["vector"] = _ranked_some(rows.select("record_id", num(at).alias("score"), num(at + 1).alias("penalty")), budget)
        at += 2
    for name, asked in (("graph", query.graph_seed), ("temporal", query.temporal_as_of)):
        if asked is not None:
            out[name] = _ranked_some(rows.select("record_id", num(at).alias("score"), zero.alias("penalty")), budget)
            at += 1
    return out


def _ranked_some(rows: DataFrame, budget: int) -> DataFrame:
    """``ranked`` of the rows that have a score.

    The others come last and are dropped behind the limit: a condition before it
    would be pushed below the shared exchange, which were then no longer shared.
    """
    best = rows.orderBy(F.col("score").desc_nulls_last(), "record_id").limit(budget).where("score is not null")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "record_id")))


def first_rows(rows: DataFrame, budget: int) -> DataFrame:
    """``fallback`` over ``narrow`` rows."""
    score = F.when(F.size("nums") >= 0, F.lit(FALLBACK_SCORE))  # of every row; it reads both columns, as the others do
    return _ranked_some(rows.select("record_id", score.alias("score"), F.lit(0.0).alias("penalty")), budget)
