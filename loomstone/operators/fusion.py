"""Reciprocal rank fusion, evidence before fallback, and result order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion.
RRF_K = 60
#: Order in which reciprocal ranks are added: the sum is the same on every run.
STREAMS = ("lexical", "vector", "graph", "temporal")
#: Lexical scores closer than this count as tied.
TIE = 1e-6


def _reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / (RRF_K + rank), F.lit(0.0))


def _merged(streams: Mapping[str, DataFrame]) -> tuple[list[str], DataFrame]:
    """Names in the order of addition, and one row per record with its score and rank in each stream and the largest penalty."""
    order = [*[s for s in STREAMS if s in streams], *[s for s in streams if s not in STREAMS]]
    rows = None
    for name in order:
        part = streams[name].select("record_id", F.lit(name).alias("stream"), "score", "penalty", "rank")
        rows = part if rows is None else rows.unionByName(part)
    picked = []
    for name in order:
        mine = F.col("stream") == name
        picked += [F.max(F.when(mine, F.col("score"))).alias(name), F.max(F.when(mine, F.col("rank"))).alias(f"{name}_rank")]
    return order, rows.groupBy("record_id").agg(*picked, F.max("penalty").alias("penalty"))


def _total(order: list[str]) -> Column:
    total = F.lit(0.0)
    for name in order:
        total = total + _reciprocal(F.col(f"{name}_rank"))
    return total


def _with_all(rows: DataFrame, present: Mapping[str, DataFrame]) -> DataFrame:
    return rows.withColumns({name: F.lit(None).cast("double") for name in STREAMS if name not in present})


def fuse(streams: Mapping[str, DataFrame]) -> DataFrame:
    """One row per record of any stream: its score in each, the penalty, and ``final`` = sum of 1 / (60 + rank) less the penalty."""
    order, fused = _merged(streams)
    out = fused.withColumn("final", _total(order) - F.col("penalty"))
    return _with_all(out, streams).drop(*[f"{name}_rank" for name in order])


def fuse_with_fallback(streams: Mapping[str, DataFrame], fallback: DataFrame) -> DataFrame:
    """``with_fallback`` of ``fuse`` in one aggregate: each stream is read once, and nothing is joined."""
    order, fused = _merged({**streams, "fallback": fallback})
    order.remove("fallback")
    evidence = F.coalesce(*[F.col(f"{name}_rank") for name in order]).isNotNull() if order else F.lit(False)
    one = _reciprocal(F.col("fallback_rank"))
    rows = _with_all(fused, streams)
    return rows.select(
        "record_id", *STREAMS, F.when(evidence, F.col("penalty")).otherwise(0.0).alias("penalty"), F.when(evidence, _total(order) - F.col("penalty")).otherwise(one + one + one).alias("final"),
        F.when(evidence, F.coalesce(F.col("temporal"), F.col("graph"))).otherwise(1.0).alias("relational"), F.when(evidence, 0).otherwise(1).alias("tier"),
    )


def with_fallback(evidence: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """Evidence rows (tier 0), then fallback rows that are no evidence (tier 1).

    A fallback row is a candidate of three streams that rank alike, so it gets
    three times its reciprocal rank, counted over evidence rows too.
    """
    one = _reciprocal(F.col("rank"))
    none = [F.lit(None).cast("double").alias(s) for s in STREAMS]
    rest = fallback.select("record_id", *none, F.lit(0.0).alias("penalty"), (one + one + one).alias("final"), F.lit(1.0).alias("relational"), F.lit(1).alias("tier"))
    if evidence is None:
        return rest
    relational = F.coalesce(F.col("temporal"), F.col("graph"))
    first = evidence.select("record_id", *STREAMS, "penalty", "final", relational.alias("relational"), F.lit(0).alias("tier"))
    return first.unionByName(rest.join(evidence.select("record_id"), "record_id", "left_anti"))


def lexical_spread(fused: DataFrame) -> DataFrame:
    """``spread`` and ``tied`` over the fused rows: no finite lexical score counts as tied."""
    spread = F.max("lexical") - F.min("lexical")
    return fused.agg(spread.alias("spread"), F.coalesce(spread <= TIE, F.lit(True)).alias("tied"))


def positioned(fused: DataFrame, by_text: bool, by_vector: bool) -> DataFrame:
    """Adds ``position`` from 1.

    With a text whose scores differ: lexical, then vector, then final score.
    Else with a vector: vector, then final. Else evidence before fallback by
    final score. Rows without the leading score follow by final score alone,
    whatever their tier. Which order holds depends on the scores, so the keys do.

    The input is bounded by the streams' budgets.
    """
    everything = Window.partitionBy()
    untied = F.coalesce(F.max("lexical").over(everything) - F.min("lexical").over(everything) > TIE, F.lit(False)) if by_text else F.lit(False)
    mode = F.when(untied, "lexical").when(F.lit(by_vector), "vector").otherwise("tier")
    keyed = fused.withColumn("mode", mode)
    in_lexical, in_vector = F.col("mode") == "lexical", F.col("mode") == "vector"
    order = [
        F.when(in_lexical, F.col("lexical")).desc_nulls_last(),
        F.when(in_vector | (in_lexical & F.col("lexical").isNotNull()), F.col("vector")).desc_nulls_last(),
        F.when(F.col("mode") == "tier", F.col("tier")).asc_nulls_last(), F.col("final").desc(), F.col("record_id").asc(),
    ]
    return keyed.withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("mode")


def guarded(candidates: DataFrame, visible: DataFrame) -> DataFrame:
    """Candidates that are visible after all."""
    return candidates.join(visible.select("record_id"), "record_id", "left_semi")


def guard_counts(candidates: DataFrame, visible: DataFrame) -> DataFrame:
    """``checked`` and ``removed`` of that guard."""
    known = visible.select("record_id", F.lit(True).alias("known"))
    return candidates.join(known, "record_id", "left").agg(F.count("*").alias("checked"), F.count_if(F.col("known").isNull()).alias("removed"))


def materialize(candidates: DataFrame, hot: DataFrame, sealed: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates with their columns from the hot row, or else the sealed one. Candidates are few; they are broadcast."""
    few = F.broadcast(candidates)
    from_hot = hot.join(few, "record_id").select(*candidates.columns, *columns, F.lit("hot").alias("origin"))
    left = few.join(from_hot.select("record_id"), "record_id", "left_anti")
    return from_hot.unionByName(sealed.join(F.broadcast(left), "record_id").select(*candidates.columns, *columns, F.lit("sealed").alias("origin")))
