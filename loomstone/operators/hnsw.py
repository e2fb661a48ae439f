"""Navigable small-world graphs over vectors, built and searched in shards (an index for cosine neighbours).

Each field's vectors are dealt into shards of bounded size by the hash of their
id. A shard's graph is built in one task, in the order of ids and with levels
drawn from the ids' hashes, so the same rows give the same graph anywhere. A
search descends every shard's layers, keeps the best ``ef`` it meets on the
lowest one, and merges the shards' results; a shard that is not larger than
``ef`` is scanned whole.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Neighbours of a node above the lowest layer (twice as many on it), candidates while building and while searching.
LINKS, BUILDING, SEARCHING = 16, 64, 64
#: Vectors of a shard, and the highest layer.
SHARD, TOP = 20_000, 16

GRAPH = "field string, shard int, dims int, id string, vector array<float>, layer int, neighbours array<array<int>>"


def layer_of(hashes: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Layers with a share of ``1 / links`` of the nodes of the layer below, from 64-bit hashes."""
    u = ((hashes.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    return np.minimum(np.floor(-np.log(u) / math.log(links)), TOP).astype(np.int32)


class Graph:
    """Unit vectors and, for each node, its neighbours by layer. Nodes are in the order of their ids, so ties are the smaller place's."""

    def __init__(self, vectors: np.ndarray, layers: np.ndarray, neighbours: list[list[list[int]]] | None = None):
        self.v, self.layers = vectors, layers
        self.near = neighbours if neighbours is not None else [[[] for _ in range(int(k) + 1)] for k in layers]
        self.entry = int(np.argmax(layers)) if len(layers) else -1

    def walk(self, query: np.ndarray, starts: list[int], layer: int, ef: int) -> list[tuple[float, int]]:
        """The best ``ef`` nodes that a best-first walk of a layer meets: nearest first."""
        score = self.v[starts] @ query
        seen = set(starts)
        ahead = [(-float(s), i) for s, i in zip(score, starts, strict=True)]
        heapq.heapify(ahead)
        best = [(float(s), -i) for s, i in zip(score, starts, strict=True)]
        heapq.heapify(best)
        while ahead:
            far, node = heapq.heappop(ahead)
            if len(best) >= ef and -far < best[0][0]:
                break
            new = [i for i in self.near[node][layer] if i not in seen]
            if not new:
                continue
            seen.update(new)
            for s, i in zip((self.v[new] @ query).tolist(), new, strict=True):
                if len(best) < ef or (s, -i) > best[0]:
                    heapq.heappush(ahead, (-s, i))
                    heapq.heappush(best, (s, -i))
                    if len(best) > ef:
                        heapq.heappop(best)
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]

    def descend(self, query: np.ndarray, to: int, entry: int) -> int:
        """The nearest node of layer ``to + 1`` from which that layer's walk begins."""
        for layer in range(int(self.layers[entry]), to, -1):
            entry = self.walk(query, [entry], layer, 1)[0][1]
        return entry

    def _linked(self, node: int, layer: int, found: list[tuple[float, int]], links: int) -> None:
        """Links a new node to the nearest found, and keeps each neighbour's list within bounds."""
        self.near[node][layer] = [i for _, i in found[:links]]
        for other in self.near[node][layer]:
            own = self.near[other][layer]
            own.append(node)
            if len(own) > links:
                order = np.lexsort((own, -(self.v[own] @ self.v[other])))
                self.near[other][layer] = [own[k] for k in order[:links]]

    @classmethod
    def build(cls, vectors: np.ndarray, layers: np.ndarray, links: int = LINKS, ef: int = BUILDING) -> Graph:
        g = cls(vectors, layers)
        entry = 0
        for node in range(1, len(vectors)):
            own, at = int(layers[node]), entry
            high = int(layers[entry])
            if high > own:
                at = g.descend(vectors[node], own, entry)
            starts = [at]
            for layer in range(min(own, high), -1, -1):
                found = g.walk(vectors[node], starts, layer, ef)
                g._linked(node, layer, found, links * 2 if layer == 0 else links)
                starts = [i for _, i in found]
            if own > high:
                entry = node
        g.entry = entry
        return g

    def search(self, query: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if len(self.v) <= max(ef, k):
            score = self.v @ query
            return [(float(score[i]), int(i)) for i in np.lexsort((np.arange(len(score)), -score))[:k]]
        return self.walk(query, [self.descend(query, 0, self.entry)], 0, max(ef, k))[:k]


def _unit(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-300)[:, None]


def build(vectors: DataFrame, shard: int = SHARD, links: int = LINKS, ef: int = BUILDING) -> DataFrame:
    """The index of ``field, id, vector`` rows: one row a node, with its neighbours' places in the shard by layer.

    Null, empty, zero and non-finite vectors are not indexed. Fields and lengths
    have shards of their own, as many as their rows need.
    """
    v = F.col("vector")
    good = F.size(v) > 0
    good &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("field", F.col("id").cast("string").alias("id"), v.cast("array<float>").alias("vector")).where(v.isNotNull() & good).withColumn("dims", F.size("vector"))
    sizes = rows.groupBy("field", "dims").agg(F.count("*").alias("n"))
    dealt = rows.join(F.broadcast(sizes), ["field", "dims"]).withColumn("h", F.xxhash64("field", "id"))
    dealt = dealt.withColumn("shard", F.pmod("h", F.ceil(F.col("n") / shard)).cast("int")).drop("n")

    def graph(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        g = Graph.build(_unit(part.column("vector"), part.column("dims")[0].as_py()), layer_of(part.column("h").to_numpy(), links), links, ef)
        out = part.select(["field", "shard", "dims", "id", "vector"])
        return out.append_column("layer", pa.array(g.layers)).append_column("neighbours", pa.array(g.near, pa.list_(pa.list_(pa.int32()))))

    return dealt.groupBy("field", "dims", "shard").applyInArrow(graph, GRAPH)


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = SEARCHING) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest found for each of ``query_id, field, vector``, ties to the smaller id.

    Every shard of a query's field is searched in its own task; each passes on
    ``k`` rows a query. Queries go in blocks, so a block is what a task holds
    beside its shard.
    """
    shards = index.select("field", "dims", "shard").distinct()
    asked = queries.select(F.col("query_id"), "field", F.col("vector").cast("array<float>").alias("vector")).withColumn("dims", F.size("vector"))
    routed = asked.join(F.broadcast(shards), ["field", "dims"])

    def cell(own: pa.Table, nodes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and nodes.num_rows:
            nodes = nodes.sort_by("id")
            dims, ids = nodes.column("dims")[0].as_py(), nodes.column("id").to_pylist()
            g = Graph(_unit(nodes.column("vector"), dims), nodes.column("layer").to_numpy(), nodes.column("neighbours").to_pylist())
            for qid, q in zip(own.column("query_id").to_pylist(), _unit(own.column("vector"), dims), strict=True):
                out += [(qid, ids[i], s) for s, i in g.search(q, k, ef)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], own.schema.field("query_id").type), "id": pa.array(columns[1], pa.string()), "score": pa.array(columns[2], pa.float64())})

    key = ["field", "dims", "shard"]
    own_nodes = index.select(*[F.col(c).alias(c) for c in index.columns]).toDF(*index.columns)
    kind = dict(queries.dtypes)["query_id"]
    found = routed.groupBy(*key).cogroup(own_nodes.groupBy(*key)).applyInArrow(cell, f"query_id {kind}, id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


