"""Which rows share a band key: keys in buckets, eight bytes an entry, and the first round of their components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, freeing

#: Band keys that a bucket takes, and that a task holds before it passes them on.
BUCKET_KEYS, FLUSH = 1_000_000, 2_000_000


def buckets_for(keys: float) -> int:
    """Buckets of so many band keys."""
    return 1 << max(4, math.ceil(math.log2(max(1, keys / BUCKET_KEYS))))


def ordered(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values.sort()
    keep = np.empty(len(values), bool)
    keep[:1] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def packed(entries: np.ndarray) -> bytes:
    """Sorted entries, their upper halves as differences in planes of bytes: most of the planes are zeros."""
    steps = np.diff((entries >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes() + entries.astype(np.uint32).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 8
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(32) | np.frombuffer(blob, np.uint32, n, 4 * n)


def banded(parts: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, entries``: per bucket of band keys, 32 more bits of each key and the 32-bit tag of its row in eight bytes.

    ``parts`` are arrays of keys, one row of them a tag, and the tags. Two rows of
    one tag never meet: one pair in 2^32.
    """
    bits = np.uint64(int(math.log2(buckets)))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        keys, tags = (np.concatenate(part) for part in zip(*held, strict=True))
        which = (keys >> np.uint64(64) - bits).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(which, kind="stable")
        which, entry = which[order], (keys << bits & ~np.uint64(0xFFFFFFFF) | tags)[order]
        cuts = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
        rows = [(int(which[a]), packed(ordered(entry[a:b]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])

    for keys, tags in parts:
        if keys.size:
            held.append((keys.ravel(), np.repeat(tags, keys.shape[1])))
            size += keys.size
        if size >= FLUSH:
            yield flushed()
            held, size = [], 0
    if held:
        yield flushed()


def _met(parts: pa.Table) -> pa.Table:
    """One bucket's band keys under which several rows meet: every row's tag, the least tag of the key, and their number."""
    entries = ordered(np.concatenate([unpacked(x) for x in parts.column("entries").to_pylist()]))
    low = (entries >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1])[: len(low)])
    n = np.diff(np.append(starts, len(low)))
    starts, n = starts[n > 1], n[n > 1]
    at = np.repeat(starts - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
    tags = entries.astype(np.uint32).astype(np.int64)
    bucket = parts.column("bucket")[0].as_py()
    return pa.table({"key": pa.array((bucket << 32) + low[at].astype(np.int64)), "tag": pa.array(tags[at]), "lead": pa.array(np.repeat(tags[starts], n)), "n": pa.array(np.repeat(n, n).astype(np.int32))})


def met(entries: DataFrame) -> DataFrame:
    """``key, tag, lead, n``, written: the rows that share a band key with others, by tag, with the key's least tag and number of rows.

    A row is sent once a task and bucket, so a key holds no copies; what one
    reducer reads follows ``BUCKET_KEYS``, not the most common row.
    """
    return cut(entries.groupBy("bucket").applyInArrow(freeing(_met), "key long, tag long, lead long, n int"))


def first_round(met: DataFrame, nodes: DataFrame, carried: list[str], possible: str, extras: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Lists ``id, key, leader`` of the keys of more than two rows, and pairs ``a < b`` with leaders, written.

    ``nodes`` has ``id, tag`` and the columns named. A pair has ``near``, whether
    ``possible`` holds of its two sides' ``carried`` columns, prefixed ``x_`` and
    ``y_``, and its sides' extras, suffixed ``_a`` and ``_b``. A tag that several
    nodes share stands for all of them.
    """

    def side(name: str, prefix: str) -> DataFrame:
        return nodes.select(F.col("tag").alias(f"tag_{name}"), F.col("id").alias(name), *[F.col(e).alias(f"{e}_{name}") for e in extras], *[F.col(c).alias(f"{prefix}_{c}") for c in carried])

    by_tag = met.where("tag <> lead").select(F.col("tag").alias("tag_a"), F.col("lead").alias("tag_b")).distinct()
    pairs = by_tag.join(side("a", "x"), "tag_a").join(side("b", "y"), "tag_b").where("a <> b")
    swap = F.col("a") > F.col("b")
    moved = [F.when(swap, F.col(f"{e}_{q}")).otherwise(F.col(f"{e}_{p}")).alias(f"{e}_{p}") for e in extras for p, q in ("ab", "ba")]
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *moved, F.expr(possible).alias("near")).distinct())
    leaders = nodes.groupBy(F.col("tag").alias("lead")).agg(F.min("id").alias("leader"))
    return met.where("n > 2").join(nodes.select("tag", "id"), "tag").join(leaders, "lead").select("id", "key", "leader"), pairs
