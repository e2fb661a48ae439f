"""Mixing sources to target weights by capped water-filling (operator 7).

``targets`` clamps each source at ``max_epochs`` times its size and reshares
the excess by weight until no source is above its clamp. ``mix`` then gives
each document its whole repetitions and, in a seeded order, the words of the
fractional repetition. All sizes are integers, so reruns agree exactly.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, private, quoted, trimmed

#: Hex digits of a document's seeded hash that name its bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes other than space and \\t-\\r; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (
        F.size(parts)
        - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    ).cast("long")


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``source, source_size, weight`` with ``target``: the share of the total by weight, clamped.

    The clamp is ``max_epochs * source_size``. With sources in order of clamp
    over weight, the level at position i spends what the i sources before it
    leave; the first source whose clamp reaches its level ends the clamped
    ones. An empty input gives an empty result; a source of size 0 gets 0. One
    row per source goes through one window.
    """
    cap = F.col("source_size") * max_epochs
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        sources.withColumn("ratio", cap / F.col("weight"))
        .withColumn("pos", F.row_number().over(ordered))
        .withColumn("spent", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("spent")) / F.col("weight_left"))
    )
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.col("pos"))).over(whole)
    chosen = levels.withColumn("first_open", first).withColumn(
        "open_level", F.max(F.when(F.col("pos") == F.col("first_open"), F.col("level"))).over(whole)
    )
    clamped = F.col("first_open").isNull() | (F.col("pos") < F.col("first_open"))
    target = F.when(clamped, cap.cast("double")).otherwise(F.least(F.col("open_level") * F.col("weight"), cap.cast("double")))
    return chosen.select("source", "source_size", "weight", target.alias("target"))


def cycled_weights(sources: DataFrame, cycle: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Weights ``cycle`` repeating over sources in code point order, null last."""
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(position, F.lit(len(cycle))) + 1).cast("int"))
    return sources.withColumn("weight", weight.cast("long"))


def row_name() -> Column:
    """128 bits that name a row by doc_id, source and text."""
    return F.concat_ws(":", F.hex(F.xxhash64("doc_id", "source", "text")), F.hex(F.xxhash64(F.lit(1), "doc_id", "source", "text")))


def mix(docs: DataFrame, cycle: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, row, source, size, source_size, target, taken`` for every row of ``docs``; ``row`` names a row by 128 bits of doc_id, source and text.

    ``size`` counts words; ``taken`` the words that the mix takes of the
    document. A source's words sum to its target rounded to whole words: each
    document is taken ``k`` whole times, and in the order of a seeded hash of
    doc_id the remainder is spent on further repetitions, the last of them in
    part. Null text has size 0; null source is a source of its own; a null
    doc_id hashes as the empty text; repeated rows count one by one.

    One scan of the texts; after it only narrow rows move. The seeded order is
    cut into 4,096 buckets a source whose offsets come from bucket sums, so a
    hot source is spread over as many tasks.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = cut(docs.select("doc_id", row_name().alias("row"), "source", word_count(F.col("text")).alias("size"), key.alias("key")))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    plan = targets(cycled_weights(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cycle), max_epochs)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)).alias("offset"))
    offsets = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select(
        F.col("o.source").alias("source"), "bucket", "offset", "source_size", "target",
        F.floor(F.col("target") + 0.5).cast("long").alias("goal"),
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    joined = placed.alias("r").join(
        offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bucket") == F.col("o.bucket"))
    )
    size, start = F.col("source_size"), F.col("offset") + F.col("before")
    whole = F.when(size > 0, F.floor(F.col("goal") / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("goal") - whole * size
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return joined.select(
        F.col("r.doc_id").alias("doc_id"), "row", F.col("r.source").alias("source"), "size", "source_size", "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
    )


def apply(docs: DataFrame, cycle: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole repetition, and one with the first words of a part.

    All columns stay; ``n_chars``, if there, follows the text. Documents of which
    nothing is taken, those without words among them, have no rows. Rows that
    repeat doc_id, source and text are taken as often as together.
    """
    taken = mix(docs, cycle, max_epochs, seed).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("long")
    per_row = taken.groupBy("row").agg(F.sum(whole).alias("whole"), F.max(F.col("taken") % F.col("size")).alias("part"))
    keyed = docs.select(F.struct(*[quoted(c).alias(n) for c, n in zip(docs.columns, private(docs.columns), strict=True)]).alias("doc"), row_name().alias("row"))
    once = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    joined = keyed.join(per_row, "row").withColumn("once", once).where("once = 1")
    names, schema = docs.columns, docs.schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            whole, part = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy()
            own = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names)
            yield own.take(pa.array(np.repeat(np.arange(batch.num_rows), whole)))
            some = np.flatnonzero(part)
            if len(some):
                rows = own.take(pa.array(some)).to_pylist()
                for row, words in zip(rows, part[some].tolist(), strict=True):
                    row["text"] = first_words(row["text"], words)
                    if "n_chars" in row:
                        row["n_chars"] = len(row["text"])
                yield pa.RecordBatch.from_pylist(rows, own.schema)

    return joined.select("doc.*", "whole", "part").mapInArrow(trimmed(batches), schema)


def first_words(text: str, words: int) -> str:
    """The text up to the end of that many words."""
    at = 0
    for m in itertools.islice(re.finditer(r"[^\x20\x09-\x0D]+", text), words):
        at = m.end()
    return text[:at]


#: Water-filling round by round needs no fixed number of rounds here: the level is found by its closed form.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
), r AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w
), l AS (
  SELECT *, row_number() OVER o AS pos, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)
), v AS (
  SELECT *, CAST(total - spent AS DOUBLE) / CAST(weights - used AS DOUBLE) AS level FROM l
), f AS (
  SELECT *, min(CASE WHEN ratio >= level THEN pos END) OVER () AS first_open FROM v
), g AS (
  SELECT *, max(CASE WHEN pos = first_open THEN level END) OVER () AS open_level FROM f
), t AS (
  SELECT source, source_size,
         CASE WHEN first_open IS NULL OR pos < first_open THEN CAST(3 * source_size AS DOUBLE)
              ELSE least(open_level * weight, CAST(3 * source_size AS DOUBLE)) END AS target
  FROM g
), c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM c
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, goal - whole * source_size - start)) AS BIGINT) AS taken
FROM k
"""
