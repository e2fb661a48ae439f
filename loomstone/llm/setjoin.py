"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones (operator 5).

A document's set holds its distinct five-word shingles. Shingles are ordered
rarest first. Two sets that link share shingles within a prefix of that order,
a quarter of each set. Sets below a boundary size meet small sets on pairs of
prefix shingles (subsets of two), which few unlinked sets share; a pair with a
set at or above the boundary meets on the inverted list of one prefix shingle.
The boundary is where the pairs of a set's prefix come to cost as much as the
lists they replace, from list lengths counted over the whole table.

A shingle that only one set holds leads to no pair, so it fills the prefix
without being written anywhere: most sets are done by then.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import kernels
from loomstone.llm.components import Links, components
from loomstone.llm.scratch import cut, freeing, private, quoted, trimmed

#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 75
#: Bits of the broadcast filters; past that many entries they only let more through.
SHARED_BITS, ID_BITS = 1 << 27, 1 << 24
#: Most frequent shingles whose exact order is broadcast: a bound, not a switch; others are ordered by hash.
FREQUENT = 1 << 18
#: Counting buckets: each holds a share of all shingles, so their number follows the input.
BUCKET_SHINGLES = 1_000_000
#: Shingles that a task holds before it passes on their counts.
FLUSH = 1_000_000
#: Words of 64 bits of a set's parity sketch.
SKETCH = 32
#: Largest boundary between small and large sets.
MOST_SMALL = 400


def links(intersection, a, b):
    """Whether two sets of ``a`` and ``b`` elements link."""
    return 100 * intersection >= PERCENT * (a + b - intersection)


def prefix(n: np.ndarray | int, k: int = 1):
    """Elements of a set of ``n`` within which it shares ``k`` with every set that it links to.

    A link needs an intersection of 0.75 n at least, whichever set is larger.
    """
    return n - (PERCENT * n + 99) // 100 + k


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, key`` for every row: set size and a 128-bit digest of the set (null for an empty one)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, keys = [], []
            for s in kernels.each_set(batch.column(1), WORDS):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "key"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(batches), "doc_id long, n_shingles long, key binary")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of the ids' hashes, 2 MB whatever their number: never misses one, may let others through."""
    words = ids.selectExpr("shiftrightunsigned(xxhash64(id), 40) AS place").selectExpr("shiftrightunsigned(place, 6) AS w", "shiftleft(1L, cast(place % 64 AS int)) AS b")
    packed = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(ID_BITS // 64, np.int64)
    for part in packed.repartition(8).toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out


def held(it: Iterator[pa.RecordBatch], bitmap) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` of the rows of ``keyed`` whose doc_id the broadcast bitmap may hold."""
    bits = bitmap.value
    for batch in it:
        place = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(40)
        keep = (bits[(place >> np.uint64(6)).astype(np.intp)] >> (place & np.uint64(63)).astype(np.int64)) & 1
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc_id", "text"]).filter(pa.array(keep.astype(bool)))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the hash of doc_id by which ``held`` filters."""
    return docs.select("doc_id", "text").where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))


def filtered(docs: DataFrame, bitmap) -> DataFrame:
    """Rows whose doc_id the bitmap may hold."""
    return keyed(docs).mapInArrow(trimmed(lambda it: held(it, bitmap)), "doc_id long, text string")


def _counted(it: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per bucket of shingles, the other 32 bits of each and how many sets of this part hold it, packed."""
    shift = np.uint64(64 - int(math.log2(buckets))) if buckets > 1 else None
    held: list[np.ndarray] = []
    size = 0

    def packed() -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        low = (s << np.uint64(64) - shift >> np.uint64(32) if shift is not None else s >> np.uint64(32)).astype(np.uint32)
        which = (s >> shift).astype(np.int64) if shift is not None else np.zeros(len(s), np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(s))
        many = n > 1
        rows = [(int(which[a]), low[a:b].tobytes(), np.flatnonzero(many[a:b]).astype(np.uint32).tobytes(), n[a:b][many[a:b]].astype(np.uint32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["bucket", "low", "at", "n"])

    for batch in it:
        for s in kernels.each_set(batch.column(1), WORDS):
            if len(s):
                held.append(s)
                size += len(s)
            if size >= FLUSH:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def _merged(bucket_bits: int, frequent: int):
    """Counts of one bucket: its part of the bitmap of shared shingles, its most frequent ones, and sums for the cost.

    The cost is that of lists which prefixes reach: the most frequent shingles
    stand at the end of the order.
    """

    def bucket(parts: pa.Table) -> pa.Table:
        entries = []
        for low, at, n in zip(*(parts.column(c).to_pylist() for c in ("low", "at", "n")), strict=True):
            both = (np.frombuffer(low, np.uint32).astype(np.uint64) << np.uint64(32)) + np.uint64(1)
            both[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.uint32) - np.uint32(1)
            entries.append(both)
        both = np.concatenate(entries)
        both.sort()
        low, count = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        low, count = low[starts], np.add.reduceat(count, starts, dtype=np.int64)
        shared = count > 1
        low, count = low[shared], count[shared]
        bits = np.zeros(bucket_bits, bool)
        bits[low.astype(np.uint64) * np.uint64(bucket_bits) >> np.uint64(32)] = True
        ranked = np.argsort(-count, kind="stable")
        top, rest = ranked[:frequent], count[ranked[frequent:]]
        return pa.table({
            "bucket": pa.array([parts.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "top": pa.array([low[top].tobytes()], pa.binary()), "n": pa.array([count[top].astype(np.uint32).tobytes()], pa.binary()),
            "lists": pa.array([int(rest.sum())], pa.int64()), "reads": pa.array([float((rest.astype(float) ** 2).sum())], pa.float64()),
        })

    return freeing(bucket)


class Order:
    """Rarest-first order: shingles of one set, then other shared ones by hash, then the most frequent by count."""

    def __init__(self, buckets: int, bits: np.ndarray, top: np.ndarray, count: np.ndarray, mean_list: float):
        self.buckets, self.bits, self.mean_list = buckets, bits, mean_list
        order = np.argsort(top)
        self.top, self.count = top[order], count[order]

    def shared(self, s: np.ndarray) -> np.ndarray:
        """Which shingles more than one set may hold."""
        per = np.uint64(len(self.bits) * 8 // self.buckets)
        b = np.uint64(int(math.log2(self.buckets)))
        bucket, low = (s >> np.uint64(64) - b, s << b >> np.uint64(32)) if b else (s * np.uint64(0), s >> np.uint64(32))
        place = bucket * per + (low * per >> np.uint64(32))
        return ((self.bits[(place >> np.uint64(3)).astype(np.intp)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)

    def rank(self, s: np.ndarray) -> np.ndarray:
        """Counts of the frequent shingles, 0 for others."""
        if not len(self.top):
            return np.zeros(len(s), np.int64)
        short = self.short(s)
        i = np.minimum(np.searchsorted(self.top, short), len(self.top) - 1)
        return np.where(self.top[i] == short, self.count[i], 0)

    def short(self, s: np.ndarray) -> np.ndarray:
        """Bucket and low bits as one number: what counting tells apart."""
        return s >> np.uint64(64 - 32 - int(math.log2(self.buckets)))

    def boundary(self) -> int:
        """The largest size whose prefix has no more pairs than its lists have entries."""
        best = 1
        for n in range(2, MOST_SMALL):
            p = prefix(n, 2)
            if p * (p - 1) / 2 <= prefix(n) * self.mean_list:
                best = n
        return best


def order_of(docs: DataFrame, bitmap, shingles: int) -> Order:
    """Counts every set's shingles and returns the order; what reaches the driver is bounded by the constants above."""
    buckets = 1 << max(4, math.ceil(math.log2(max(1, shingles / BUCKET_SHINGLES))))
    bucket_bits = max(8, SHARED_BITS // buckets)
    parts = keyed(docs).mapInArrow(trimmed(lambda it: _counted(held(it, bitmap), buckets)), "bucket int, low binary, at binary, n binary")
    merged = parts.groupBy("bucket").applyInArrow(_merged(bucket_bits, max(1, FREQUENT // buckets)), "bucket int, bits binary, top binary, n binary, lists long, reads double")
    bits = np.zeros(buckets * bucket_bits // 8, np.uint8)
    top, count, lists, reads = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0.0
    for row in merged.collect():
        at = row.bucket * bucket_bits // 8
        bits[at : at + bucket_bits // 8] = np.frombuffer(row.bits, np.uint8)
        low = np.frombuffer(row.top, np.uint32).astype(np.uint64)
        top.append((np.uint64(row.bucket) << np.uint64(32)) + low)
        count.append(np.frombuffer(row.n, np.uint32).astype(np.int64))
        lists, reads = lists + row.lists, reads + row.reads
    return Order(buckets, bits, np.concatenate(top), np.concatenate(count), reads / lists if lists else 2.0)


def _keys(order: Order, boundary: int):
    """Keys under which each set looks for partners."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for batch in it:
            ids, keys, wide, room = [], [], [], []
            for doc, s in zip(batch.column(0).to_numpy(), kernels.each_set(batch.column(1), WORDS), strict=True):
                n = len(s)
                if n < 2:
                    continue  # sets of one link to equal sets only, which are one row by now
                shared = s[o.shared(s)]
                alone, p1 = n - len(shared), prefix(n)
                if alone >= prefix(n, 2):
                    continue
                shared = shared[np.lexsort((shared, o.rank(shared)))]
                one = shared[: max(0, p1 - alone)]
                large = n >= boundary
                ids.append(np.full(len(one), doc))
                keys.append(kernels.mixed(one))
                wide.append(np.full(len(one), large))
                room.append(len(shared) - np.arange(len(one)))
                if not large:
                    two = shared[: max(0, prefix(n, 2) - alone)]
                    i, j = np.triu_indices(len(two), 1)
                    pairs = kernels.mixed(np.minimum(two[i], two[j]) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(two[i], two[j]) + np.uint64(1))
                    ids.append(np.full(len(pairs), doc))
                    keys.append(pairs)
                    wide.append(np.full(len(pairs), True))
                    room.append(len(shared) - i)
            if ids:
                columns = [pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(wide)), pa.array(np.concatenate(room), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "wide", "room"])

    return batches


def sketches(docs: DataFrame, bitmap) -> DataFrame:
    """``id, n`` and a parity bitmap of each set, in columns ``p0`` to ``p31``.

    Two bitmaps differ in no more bits than the sets differ in elements.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(it, bitmap):
            sizes, words = [], np.zeros((batch.num_rows, SKETCH), np.int64)
            for i, s in enumerate(kernels.each_set(batch.column(1), WORDS)):
                sizes.append(len(s))
                odd = np.bincount((s >> np.uint64(64 - 11)).astype(np.int64), minlength=SKETCH * 64) & 1
                words[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *[pa.array(words[:, k]) for k in range(SKETCH)]], ["id", "n", *[f"p{k}" for k in range(SKETCH)]])

    return keyed(docs).mapInArrow(trimmed(batches), "id long, n long, " + ", ".join(f"p{k} long" for k in range(SKETCH)))


#: What a pair that links satisfies under the first key that its sets share: sizes, the shared shingles that are
#: left from there on (an intersection has 3/7 of both sizes at least), and the sketches (1/7 may differ at most).
POSSIBLE = (
    f"100 * least(x_n, y_n) >= {PERCENT} * greatest(x_n, y_n) and 7 * least(x_room, y_room) >= 3 * (x_n + y_n) and 7 * ("
    + " + ".join(f"bit_count(x_p{k} ^ y_p{k})" for k in range(SKETCH))
    + ") <= x_n + y_n"
)


def _linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that link, by their whole texts."""
    for batch in it:
        keep = []
        for x, y in zip(kernels.each_set(batch.column(2), WORDS), kernels.each_set(batch.column(3), WORDS), strict=True):
            small, big = (x, y) if len(x) <= len(y) else (y, x)
            if 100 * len(small) < PERCENT * len(big):
                keep.append(False)
                continue
            both = np.sort(np.concatenate([x, y]))
            keep.append(bool(links(int((both[1:] == both[:-1]).sum()), len(x), len(y))))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the smallest doc_id that links reach.

    Equal sets link; empty sets (null or blank text) with nothing. A row with a
    null doc_id has its set size and a null component; rows that repeat a doc_id
    share a component if both link to it. The result is exact: order, filters
    and boundary decide only what is compared.

    Equal sets become one representative first, so groups of copies cost one
    set. Texts are read once each to describe, to count and to key, and then only
    texts of candidate pairs move.
    """
    spark = docs.sparkSession
    sets = cut(describe(docs))
    reps = sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"))
    reps = cut(reps)
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bitmap = spark.sparkContext.broadcast(id_filter(reps.select("id")))
    order = order_of(docs, bitmap, total)
    shipped = spark.sparkContext.broadcast(order)
    keys = _keys(shipped, order.boundary())
    members = keyed(docs).mapInArrow(trimmed(lambda it: keys(held(it, bitmap))), "id long, key long, wide boolean, room int")
    sizes = reps.select("id", "n")

    def verify(pairs: DataFrame) -> DataFrame:
        a = sizes.select(F.col("id").alias("a"), F.col("n").alias("na"))
        b = sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"))
        near = cut(pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)").select("a", "b"))
        asked = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
        wanted = spark.sparkContext.broadcast(id_filter(asked))
        texts = cut(filtered(docs, wanted))  # for both sides
        xa, xb = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        return near.join(xa, "a").join(xb, "b").select("a", "b", "ta", "tb").mapInArrow(trimmed(_linked), "a long, b long").distinct()

    def sketched(ids: DataFrame) -> DataFrame:
        return sketches(docs, spark.sparkContext.broadcast(id_filter(ids))).distinct()

    labels = components(Links(members, verify, sketches=sketched, possible=POSSIBLE))
    by_key = reps.join(labels, "id", "left").select("key", F.coalesce("label", "id").alias("component"))
    joined = sets.join(by_key, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id.

    Rows are compared by their texts, also rows that repeat a doc_id: a row goes
    only if its own text is linked to one that stays, or if it repeats the doc_id
    and the text of a row that stays. Rows with a null doc_id stay, and rows with
    an empty set but for repeats.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    repeated = cut(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    names = private(docs.columns)
    own = docs.select(*[quoted(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("doc_id").cast("long").alias("doc_id"), "text")
    if repeated.isEmpty():
        gone = join(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id")
        kept = own.join(gone, "doc_id", "left_anti")
    else:
        # Every text of a doc_id is a document of its own, numbered in the order of doc_id.
        digest = F.coalesce(F.md5("text"), F.lit(""))
        texts = own.where("doc_id is not null").select("doc_id", digest.alias("digest")).distinct()
        numbered = cut(texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "digest").withColumn("uid", F.monotonically_increasing_id()))
        every = own.withColumn("digest", digest).join(numbered, ["doc_id", "digest"], "left")
        rows = cut(every.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy("digest"))).where("rank = 1 or uid is null"))
        gone = join(rows.select(F.col("uid").alias("doc_id"), "text")).where("component_id <> doc_id").select(F.col("doc_id").alias("uid"))
        kept = rows.join(gone, "uid", "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


#: The same for a table ``{docs}`` without null or repeated doc_ids, by all pairs of documents that share a shingle.
JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM {docs}
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [list_aggregate(words, 'string_agg', ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))) END AS shingles
  FROM w
), n AS (
  SELECT doc_id, len(shingles) AS n FROM s
), x AS (
  SELECT doc_id, hash(unnest(shingles)) AS h, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.h = b.h AND a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n
"""
