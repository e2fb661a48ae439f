"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 9).

A vector is scaled to length 1, rotated at random into ``bits`` dimensions, and
kept as its signs, packed into words, with one correction scalar: the inner
product of the rotated vector and its own sign vector. A query is rotated alike
and cut into bit planes, so the inner product with a code is a few AND and
popcount operations on words. It is estimated from bits and scalar with a bound
on the error, and only vectors whose upper bound reaches the query's k-th best
lower bound are scored exactly, where they meet the query: of a block of
candidates only the k best leave it.

Vectors lie in cells around coarse centroids. A query reads the cells next to
it first; the k-th best score found there then excludes every cell whose angle
from the query, less the cell's own radius, is too wide.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, trimmed

#: Code length. Vectors with fewer dimensions are padded: the error falls with the root of the length.
BITS = 256
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 3.0
#: Bits of a query's quantised coordinates.
PLANES = 8
#: Rows of a block of candidates and of a block of queries, and numbers in the vectors of either.
CANDIDATES, QUERIES, NUMBERS = 4096, 4096, 1 << 20
#: Numbers in the vectors that are scored exactly at once.
EXACT_NUMBERS = 1 << 19
#: Vectors, and numbers in them, of the bounded sample that the centroids are fitted on; most centroids; cells that a query reads first.
SAMPLE, SAMPLE_NUMBERS, CELLS, FIRST = 8192, 4_000_000, 256, 4


@functools.lru_cache(maxsize=8)
def rotation(dims: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """``bits x dims`` with orthonormal columns; the same everywhere."""
    bits = max(bits, -(-dims // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((bits, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision. Scaling by a power of two first keeps norms finite."""
    _, e = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    v = np.ldexp(vectors, -e[:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair: sums by row, so equal rows give equal results wherever they stand."""
    _, ea = np.frexp(np.abs(a).max(axis=1, initial=0.0))
    _, eb = np.frexp(np.abs(b).max(axis=1, initial=0.0))
    a, b = np.ldexp(a, -ea[:, None]), np.ldexp(b, -eb[:, None])
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def encode(vectors: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Signs of each row packed into words of 64 bits, and the correction scalar."""
    rotated = unit(vectors).astype(np.float32) @ rotation(vectors.shape[1], bits).T
    return np.packbits(rotated > 0, axis=1, bitorder="little").view(np.uint64), np.abs(rotated).sum(axis=1) / math.sqrt(rotated.shape[1])


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines, queries by rows, and the half width of each bound.

    The half width covers ``WIDTH`` standard deviations of the estimate and the
    most that quantising the query can change.
    """
    rotated = unit(queries).astype(np.float32) @ rotation(queries.shape[1], bits).T
    d = rotated.shape[1]
    low = rotated.min(axis=1, keepdims=True)
    step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-30)
    cut_ = np.rint((rotated - low) / step).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    dots = np.empty((len(queries), len(codes)))
    for i in range(len(queries)):
        planes = np.packbits(cut_[i][None, :] >> np.arange(PLANES, dtype=np.uint8)[:, None] & 1, axis=1, bitorder="little").view(np.uint64)
        total = np.zeros(len(codes), np.int64)
        for j in range(PLANES):
            total += np.bitwise_count(codes & planes[j]).sum(axis=1, dtype=np.int64) << j
        whole = float(low[i, 0]) * d + float(step[i, 0]) * float(cut_[i].sum(dtype=np.int64))
        dots[i] = (2 * (float(step[i, 0]) * total + float(low[i, 0]) * ones) - whole) / math.sqrt(d)
    f = np.clip(scalars, 1e-6, 1)
    spread = WIDTH * np.sqrt(np.maximum(0, 1 - f * f)) / f / math.sqrt(d - 1)
    return dots / f, spread[None, :] + (step / 2) * math.sqrt(d) / f[None, :] + 1e-5


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass
class Cells:
    """Unit centroids by number of dimensions. Vectors of other lengths have one cell that holds all directions."""

    centroids: dict[int, np.ndarray]

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        """Angle of each row to each centroid; one column of a right angle and more where there are none."""
        own = self.centroids.get(vectors.shape[1])
        if own is None:
            return np.full((len(vectors), 1), math.pi)
        return np.arccos(np.clip(unit(vectors) @ own.T, -1, 1))


def fit(rows: DataFrame, cells: int | None = None) -> Cells:
    """Centroids from a bounded sample: the ``SAMPLE`` rows (and ``SAMPLE_NUMBERS`` numbers) that come first by hash.

    Of the sample's most common number of dimensions; every row is indexed
    whatever the sample holds.
    """
    wide = max(1, rows.agg(F.max("dims")).first()[0] or 1)
    drawn = rows.orderBy(F.xxhash64("id", "vector")).limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // wide))).select("dims", "vector").toArrow()
    dims = drawn.column("dims").to_numpy()
    if not len(dims):
        return Cells({})
    d = int(np.bincount(dims).argmax())
    v = unit(_matrix(drawn.filter(pa.array(dims == d)).column("vector").combine_chunks(), d))
    v = np.unique(v, axis=0)
    k = min(len(v), cells or max(1, min(CELLS, int(math.sqrt(len(v))))))
    rng = np.random.default_rng(3)
    own = v[rng.choice(len(v), k, replace=False)]
    for _ in range(8):
        near = (v @ own.T).argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, v)
        norm = np.sqrt((sums * sums).sum(axis=1))
        own = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], own)
    return Cells({d: own})


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, dims, vector`` of every vector that takes part.

    Null, empty and all-zero vectors and those holding null or non-finite
    components take no part, nor do rows without an id.
    """
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(finite).select("id", F.size(v).alias("dims"), "vector")


@dataclass
class Index:
    """``rows`` have ``id, dims, vector, cell, angle, code, scalar``."""

    rows: DataFrame
    cells: Cells


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS, cells: Cells | None = None) -> Index:
    """The index of every vector of ``usable``.

    Only the centroids are fitted, on a bounded sample; the rotation is drawn
    from a seed, and every row is indexed alike.
    """
    rows = usable(vectors, id_col, vector_col)
    own = rows.sparkSession.sparkContext.broadcast(cells or fit(rows))

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch.column(1).to_numpy()
            packed: list = [b""] * len(dims)
            scalar, cell, angle = np.zeros(len(dims)), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = _matrix(batch.column(2).take(pa.array(at)), d)
                codes, scalar[at] = encode(v, bits)
                all_angles = own.value.angles(v)
                cell[at], angle[at] = all_angles.argmin(axis=1), all_angles.min(axis=1)
                for i, code in zip(at, codes, strict=True):
                    packed[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle), pa.array(packed, pa.binary()), pa.array(scalar)], ["id", "dims", "vector", "cell", "angle", "code", "scalar"])

    return Index(rows.mapInArrow(trimmed(coded), "id long, dims int, vector array<double>, cell int, angle double, code binary, scalar double"), own.value)


def _probe(k: int, bits: int):
    """One block of queries against one block of candidates: each query's ``k`` best of them.

    Bounds from the codes decide which pairs are scored exactly; a query's k-th best
    score so far (``least``) which of these leave the block.
    """

    def block(queries: pa.Table, own: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
        if queries.num_rows and own.num_rows:
            qid, cid = queries.column("id").to_numpy(), own.column("id").to_numpy()
            dims = queries.column("dims")[0].as_py()
            qv, cv = _matrix(queries.column("vector").combine_chunks(), dims), _matrix(own.column("vector").combine_chunks(), dims)
            least = queries.column("least").to_numpy()
            codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint64).reshape(len(cid), -1)
            scalars = own.column("scalar").to_numpy()
            step = max(1, EXACT_NUMBERS // dims)
            for at in range(0, len(qid), 64):
                ids = qid[at : at + 64]
                est, half = estimate(codes, scalars, qv[at : at + 64], bits)
                low, high = est - half, est + half
                mine = cid[None, :] == ids[:, None]
                low[mine], high[mine] = -np.inf, -np.inf
                bar = least[at : at + 64]
                if low.shape[1] > k:
                    bar = np.maximum(bar, np.partition(low, -k, axis=1)[:, -k])
                q, c = np.nonzero((high >= bar[:, None]) & ~mine)
                score = np.empty(len(q))
                for i in range(0, len(q), step):
                    score[i : i + step] = cosines(qv[at + q[i : i + step]], cv[c[i : i + step]])
                keep = score >= least[at + q]
                q, c, score = q[keep], c[keep], score[keep]
                order = np.lexsort((cid[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                out["query_id"].append(ids[q[keep]])
                out["vec_id"].append(cid[c[keep]])
                out["score"].append(score[keep])
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in out.items()})

    return block


def search(indexed: Index, is_query, k: int = 5, bits: int = BITS, exact: bool = True, first: int = FIRST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every indexed row for which ``is_query`` holds.

    All rows with other ids are candidates; ties go to the smaller id; fewer
    than ``k`` candidates give fewer rows. Vectors of different lengths are not
    compared. Of equal vectors only the ``k + 1`` smallest ids can be results, so
    only these are searched.

    A query reads the codes of its ``first`` nearest cells. With ``exact``, it
    then reads every further cell that the k-th best score leaves possible, so
    nothing is lost but by the width of the code's bound; without, the cells
    read first are all. Queries and candidates meet in blocks of bounded size, of
    which a hot cell has many, and are scored there: a query takes ``k`` rows at
    most from a block, however many candidates the bounds leave possible.
    """
    spark, cells = indexed.rows.sparkSession, indexed.cells
    rows = cut(indexed.rows)
    of_equal = Window.partitionBy("v1", "v2").orderBy("id")
    codes = rows.select("id", "dims", "vector", "cell", "angle", "code", "scalar", F.xxhash64("vector").alias("v1"), F.xxhash64(F.lit(1), "vector").alias("v2"))
    codes = cut(codes.withColumn("n", F.row_number().over(of_equal)).where(F.col("n") <= k + 1).select("id", "dims", "vector", "cell", "angle", "code", "scalar"))
    # One row a cell: at most CELLS, and one for each further number of dimensions.
    held = {(r.dims, r.cell): (r.n, r.radius) for r in codes.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    radius: dict[int, np.ndarray] = {}
    for (d, cell), (_, wide) in held.items():
        own = radius.setdefault(d, np.full(len(cells.centroids[d]) if d in cells.centroids else 1, -np.inf))
        own[cell] = wide
    ways = spark.sparkContext.broadcast((cells, radius))
    queries = rows.where(is_query).select("id", "dims", "vector").withColumn("least", F.lit(float("-inf")))

    def routed(near: bool):
        """Each query with each cell that it reads in this round."""

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, wide = ways.value
            for batch in it:
                dims = batch.column(1).to_numpy()
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    part = batch.take(pa.array(at))
                    angles = own.angles(_matrix(part.column(2), d))
                    angles[:, wide[d] == -np.inf] = np.inf
                    rank = np.argsort(np.argsort(angles, axis=1, kind="stable"), axis=1)
                    if near:
                        reads = rank < first
                    else:
                        best = np.cos(np.clip(angles - wide[d][None, :], 0, math.pi))
                        reads = (rank >= first) & (best >= part.column(3).to_numpy()[:, None] - 1e-7)
                    q, cell = np.nonzero(reads & np.isfinite(angles))
                    for i in range(0, len(q), 2000):
                        rows_ = part.take(pa.array(q[i : i + 2000]))
                        yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(cell[i : i + 2000].astype(np.int32))], ["id", "dims", "vector", "least", "cell"])

        return batches

    def probed(asked: DataFrame, near: bool) -> DataFrame:
        routes = asked.mapInArrow(trimmed(routed(near)), "id long, dims int, vector array<double>, least double, cell int")
        many = routes.groupBy("dims", "cell").agg(F.count("*").alias("q"))
        sizes = spark.createDataFrame([(d, c, n) for (d, c), (n, _) in held.items()], "dims int, cell int, held long")
        most = lambda rows_: F.greatest(F.lit(1), F.least(F.lit(rows_), F.floor(F.lit(NUMBERS) / F.col("dims"))))
        plan = F.broadcast(many.join(F.broadcast(sizes), ["dims", "cell"]).select("dims", "cell", F.ceil(F.col("held") / most(CANDIDATES)).cast("int").alias("cb"), F.ceil(F.col("q") / most(QUERIES)).cast("int").alias("qb")))
        block = codes.join(plan, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "cb").cast("int")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        asking = routes.join(plan, ["dims", "cell"]).withColumn("qblock", F.pmod(F.xxhash64("id"), "qb").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)))
        key = ["dims", "cell", "block", "qblock"]
        asking, block = asking.select(*key, "id", "vector", "least"), block.select(*key, "id", "vector", "code", "scalar")
        return asking.groupBy(*key).cogroup(block.groupBy(*key)).applyInArrow(_probe(k, bits), "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = cut(best(probed(queries, True)))
    if exact:
        bars = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        asked = queries.drop("least").join(bars, "id", "left").select("id", "dims", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        found = best(found.drop("rank").unionByName(probed(asked, False)))
    return found.select("query_id", "rank", "vec_id", "score")
