"""Sharding by fixed virtual slots (operator 10).

Records hash into ``SLOTS`` virtual slots that never change. Bytes are summed
per slot, and a versioned map says which shard holds which slot. Rebalancing
edits entries of the map and never rehashes a record.
"""

from __future__ import annotations

import bisect
import heapq
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, shared_dir

#: Virtual slots. Fixed for the life of a dataset.
SLOTS = 4096
#: A text whose copies hold over 1/HEAVY of all bytes is spread by doc_id.
HEAVY = 512


#: Salts among which the rows of one heavy text are numbered.
SALTS = 64


def records(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, text_key, salt`` of every row: the one scan of the texts.

    Size is the UTF-8 bytes of the text plus 1; null text has none, so 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key"), salt.alias("salt"))


def with_virtual_slots(rows: DataFrame, slots: int = SLOTS, heavy: int = HEAVY) -> DataFrame:
    """Adds ``virtual_slot``. ``rows`` is a written table of ``records``.

    Equal texts share a slot, so a shard holds all copies of a text. Copies that
    together pass 1/``heavy`` of all bytes would unbalance the shards: those few
    texts (fewer than ``heavy``, so the list is broadcast) are dealt by doc_id
    and, where rows repeat both, by their number among those repeats. The numbers
    are counted in ``SALTS`` parts, so no task takes all rows of a text, and any
    way of reading the table gives the same slots.
    """
    by_text = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    hot = by_text.join(F.broadcast(total)).where((F.col("n") > 1) & (F.col("bytes") * heavy > F.col("total"))).select("text_key", F.lit(True).alias("hot"))
    marked = rows.join(F.broadcast(hot), "text_key", "left")
    light = marked.where("hot is null").withColumn("deal", F.xxhash64("text_key"))
    of_part = Window.partitionBy("text_key", "doc_id", "salt").orderBy("size")
    heavies = marked.where("hot").withColumn("at", F.row_number().over(of_part))
    parts = heavies.groupBy("text_key", "doc_id", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("text_key", "doc_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    h, s = heavies.alias("h"), starts.alias("s")
    same = (F.col("h.text_key") == F.col("s.text_key")) & F.col("h.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("h.salt") == F.col("s.salt"))
    dealt = h.join(s, same).select("h.*", F.xxhash64("h.text_key", "h.doc_id", F.col("s.start") + F.col("h.at")).alias("deal")).drop("at")
    return light.unionByName(dealt).withColumn("virtual_slot", F.pmod("deal", F.lit(slots)).cast("int")).drop("hot", "text_key", "salt", "deal")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: at most as many rows as there are slots."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(loads: Mapping[int, int], shards: int) -> dict[int, int]:
    """Slot to shard: slots by falling bytes, each to the shard with fewest bytes so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + load, shard))
    return out


def rebalance(current: Mapping[int, int], loads: Mapping[int, int], shards: int) -> dict[int, int]:
    """An edited map for ``shards`` shards; every entry that need not change stays.

    Slots without a shard, or of a shard that is gone, go to the emptiest
    shards. Then the fullest shard gives the emptiest one the largest slot that
    is at most half the gap between them, until no slot is. After growth only
    the new shards are given slots.
    """
    new = sorted(set(range(shards)) - set(current.values()))
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    out = {slot: shard for slot, shard in current.items() if shard < shards}
    for slot, shard in out.items():
        bisect.insort(held[shard], (loads.get(slot, 0), slot))
    sums = [sum(load for load, _ in slots) for slots in held]

    def put(load: int, slot: int, among: Sequence[int]) -> None:
        shard = min(among, key=lambda k: (sums[k], k))
        out[slot] = shard
        bisect.insort(held[shard], (load, slot))
        sums[shard] += load

    for slot in sorted((s for s in loads if s not in out), key=lambda s: (-loads[s], s)):
        put(loads[slot], slot, range(shards))
    receivers = new or range(shards)
    while True:
        full = max(range(shards), key=lambda k: (sums[k], -k))
        gap = sums[full] - min(sums[k] for k in receivers)
        at = bisect.bisect_right(held[full], (gap // 2, 1 << 62)) - 1
        if at < 0 or held[full][at][0] == 0:
            return out
        load, slot = held[full].pop(at)
        sums[full] -= load
        put(load, slot, receivers)


class SlotMaps:
    """Stored versions of the map, in a folder that driver and executors share: ``version=N`` each, never changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.listStatus(root) if fs.exists(root) else []
        return sorted(int(x.getPath().getName()[8:]) for x in found if x.getPath().getName().startswith("version="))

    def load(self, version: int | None = None) -> dict[int, int]:
        """The newest version, or the one asked for; no entries if there is none. At most ``SLOTS`` rows."""
        at = version if version is not None else (self.versions() or [None])[-1]
        if at is None:
            return {}
        return {r.virtual_slot: r.shard for r in self.spark.read.parquet(f"{self.folder}/version={at}").collect()}

    def store(self, assignment: Mapping[int, int]) -> int:
        """Writes the map as the next version. A version that another writer has just written is an error, not replaced."""
        version = (self.versions() or [0])[-1] + 1
        rows = self.spark.createDataFrame([(int(k), int(v)) for k, v in sorted(assignment.items())], "virtual_slot int, shard int")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/version={version}")
        return version


def shard(docs: DataFrame, shards: int = 8, maps: SlotMaps | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, version, shard, slot`` for every row.

    ``slot`` numbers the rows of a shard from 0 without gaps, by virtual slot
    and doc_id (null first, then size and text_crc32; repeated rows each have a
    number of their own). Shards are near equal in bytes, also where one text or
    one repeated row holds much of the table. Empty input: no rows.

    The placement is that of the newest version stored in ``maps``. Without one
    a first map is stored. With one, slots that lack a shard, a number of shards
    that has changed or bytes that have drifted edit the map, which is stored as
    the next version; entries that need not change stay.

    At most 4,096 slot sums reach the driver. Numbers come from per-slot counts
    and an order within each virtual slot, never from a whole shard in one task.
    """
    spark = docs.sparkSession
    maps = maps or SlotMaps(spark, f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}")
    return place(cut(with_virtual_slots(cut(records(docs)))), shards, maps)


def slot_loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any: at most ``SLOTS`` entries."""
    return {r.virtual_slot: (r.bytes, r.rows) for r in slot_bytes(rows).collect()}


def mapped(loads: Mapping[int, tuple[int, int]], shards: int, maps: SlotMaps) -> tuple[int, dict[int, int]]:
    """The stored map for these loads, edited and stored as the next version where that is needed; its version and entries, read back."""
    sizes, known = {k: b for k, (b, _) in loads.items()}, maps.load()
    wanted = rebalance(known, sizes, shards) if known else first_map(sizes, shards)
    if wanted != known:
        maps.store(wanted)
    version = (maps.versions() or [0])[-1]
    return version, maps.load(version) if version else {}


def place(rows: DataFrame, shards: int, maps: SlotMaps, loads: Mapping[int, tuple[int, int]] | None = None) -> DataFrame:
    """``shard`` of a written table of ``with_virtual_slots``."""
    spark, loads = rows.sparkSession, loads if loads is not None else slot_loads(rows)
    version, assignment = mapped(loads, shards, maps)
    starts, seen = [], dict.fromkeys(range(shards), 0)
    for slot in sorted(loads):
        to = assignment[slot]
        starts.append((slot, to, seen[to]))
        seen[to] += loads[slot][1]
    table = spark.createDataFrame(starts, "virtual_slot int, shard int, start long")
    order = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    placed = rows.withColumn("n", F.row_number().over(order)).join(F.broadcast(table), "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", F.lit(version).alias("version"), "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"))
