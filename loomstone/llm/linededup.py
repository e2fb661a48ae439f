"""Fuzzy line deduplication by MinHash (operator 1).

Lines are compared as sets of five-character shingles. One-permutation MinHash
signatures are banded for high recall; candidates are verified by exact Jaccard
similarity; linked lines form components by distributed union-find, and one
line of each component stays: the first by doc_id and line number.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import kernels, meeting
from loomstone.llm.components import Links, components
from loomstone.llm.meeting import ordered
from loomstone.llm.scratch import cut, private, quoted, trimmed

#: Characters of a shingle; lines link at a Jaccard similarity of PERCENT in a hundred.
CHARS, PERCENT = 5, 75
#: A pair at the threshold meets in some band with probability 0.998, one at 0.8 with 0.9999; a pair of unrelated
#: lines (a similarity of 0.05) with 5e-7. A corpus with very many more lines wants more rows and bands. Lines of any
#: length come near this, as an empty bin borrows from its own random choice of the full ones (see ``Lines.bins``).
BANDS, ROWS = 32, 6
#: Words of 64 bits of a line's parity sketch, and of the short one that goes with each candidate.
SKETCH, SHORT = 16, 4
#: Bits, as a power of two, of the broadcast bitmap of the tags of lines that met another one.
FILTER_BITS = 26

_EMPTY = np.uint32(0xFFFFFFFF)

#: Full bins of a line from which on it is cheaper to look for the lenders of each empty bin than to offer each full one to all.
FEW = 60


@functools.lru_cache(maxsize=2)
def _values(which: int) -> np.ndarray:
    """A random 64-bit value for each code point; two sets of them."""
    v = kernels.mixed(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))
    return v if which == 0 else kernels.mixed(v)


@functools.lru_cache(maxsize=1)
def _lenders() -> tuple[np.ndarray, np.ndarray]:
    """``[bin, place]`` to the bin from which a bin borrows, itself first and then all others in a random order of its own;
    and ``[lender, bin]`` to the lender's place."""
    draw = np.random.default_rng(24).random((BANDS * ROWS, BANDS * ROWS))
    np.fill_diagonal(draw, -1)
    order = np.argsort(draw, axis=1).astype(np.uint8)
    return order, np.ascontiguousarray(np.argsort(order, axis=1).T.astype(np.uint8))


def _lent_to_all(least: np.ndarray) -> np.ndarray:
    """Signatures of lines with few full bins: each full bin offers itself to all bins at once."""
    bins = BANDS * ROWS
    if not len(least):
        return least
    order, place_of = _lenders()
    row, full = np.nonzero(least != _EMPTY)
    counts = np.bincount(row, minlength=len(least))
    longest = np.argsort(-counts, kind="stable")
    first, left = (np.cumsum(counts) - counts)[longest], -counts[longest]
    place = place_of[full[first]]
    for k in range(1, -int(left[0])):
        n = int(np.searchsorted(left, -k))
        np.minimum(place[:n], place_of[full[first[:n] + k]], out=place[:n])
    source = np.empty_like(place)
    source[longest] = order.ravel().take(place + np.arange(0, bins * bins, bins))
    return np.take_along_axis(least, source.astype(np.intp), axis=1)


def _lent_to_empty(least: np.ndarray) -> np.ndarray:
    """The same signatures for lines with many full bins: each empty bin asks its lenders in turn, and soon meets a full one."""
    bins = BANDS * ROWS
    order, flat, out = _lenders()[0].ravel(), least.ravel(), least.flatten()
    at = np.flatnonzero(flat == _EMPTY)
    own = at % bins
    line, turn = at - own, own * bins
    while len(at):
        turn += 1
        lent = flat.take(line + order.take(turn))
        out[at] = lent
        left = np.flatnonzero(lent == _EMPTY)
        at, line, turn = at.take(left), line.take(left), turn.take(left)
    return out.reshape(-1, bins)


def _space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | (points - np.uint32(9) <= 4)


class Lines:
    """The lines of some texts: position, key and, on request, band keys of each line that is not blank."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        new = np.flatnonzero(self.points == 10)
        owner = np.searchsorted(offsets, new, side="right") - 1
        docs = np.concatenate([np.arange(len(texts)), owner])
        begin = np.concatenate([offsets[:-1], new + 1])
        order = np.lexsort((begin, docs))
        self.doc, begin = docs[order], begin[order]
        end = np.append(begin[1:] - 1, len(self.points))[: len(begin)]
        last = np.append(self.doc[1:] != self.doc[:-1], True)[: len(begin)]
        end[last] = offsets[self.doc[last] + 1]
        self.number = np.arange(len(begin)) - np.searchsorted(self.doc, self.doc)
        points = self.points
        while len(left := np.flatnonzero(begin < end)) and len(left := left[_space(points[begin[left]])]):
            begin[left] += 1
        while len(left := np.flatnonzero(begin < end)) and len(left := left[_space(points[end[left] - 1])]):
            end[left] -= 1
        full = np.flatnonzero(begin < end)
        self.doc, self.number, self.begin, self.end = self.doc[full], self.number[full], begin[full], end[full]
        self._sums, self._down = kernels.prefix_sums(_values(0).take(points))
        self.key = kernels.hashes_of(self._sums, self._down, self.begin, self.end)

    @property
    def check(self) -> np.ndarray:
        """Another 64 bits of each line."""
        return kernels.span_hashes(_values(1).take(self.points), self.begin, self.end)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles of the chosen lines, and the place in ``which`` of each one's line."""
        n = max(0, len(self.points) - CHARS + 1)
        rolled = (self._sums[CHARS:] - self._sums[:-CHARS])[:n] * self._down[:n] if n else np.zeros(0, np.uint64)
        begin, count = self.begin[which], self.end[which] - self.begin[which] - CHARS + 1
        long = count > 0
        size = np.where(long, count, 0)
        line = np.repeat(np.arange(len(which)), size)
        place = np.arange(len(line)) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size)
        short = np.flatnonzero(~long)
        h = rolled[place] * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (np.concatenate([h, self.key[which[short]]]), np.concatenate([line, short])) if len(short) else (h, line)

    def bins(self, which: np.ndarray) -> np.ndarray:
        """The signature of each chosen line.

        A bin keeps the least hash that falls into it; an empty bin borrows that
        of the full bin which comes first in its own random order of all bins.
        So two lines agree in each bin with the probability of their similarity,
        and the bins of a short line do not copy their neighbours.
        """
        bins = BANDS * ROWS
        h, line = self.shingles(which)
        at = h >> np.uint64(32)
        at *= np.uint64(bins)
        at >>= np.uint64(32)
        line *= bins
        line += at.view(np.int64)
        least = np.full(len(which) * bins, _EMPTY, np.uint32)
        np.minimum.at(least, line, np.minimum(h.astype(np.uint32), _EMPTY - np.uint32(1)))
        least = least.reshape(-1, bins)
        few = bins - np.count_nonzero(least == _EMPTY, axis=1) < FEW
        out = np.empty_like(least)
        out[few], out[~few] = _lent_to_all(least[few]), _lent_to_empty(least[~few])
        return out

    @staticmethod
    def bands(bins: np.ndarray) -> np.ndarray:
        """Band keys, one row a line."""
        out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(bins), 1))
        for r in range(ROWS):
            out += bins[:, r * BANDS : (r + 1) * BANDS]
            out *= kernels._PLACES[r]
        return kernels.mixed(out)

    def parities(self, which: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The size of each chosen line's shingle set, and a parity bitmap of the set in ``words`` words of 64 bits.

        Two bitmaps differ in no more bits than the sets differ in elements.
        """
        h, line = self.shingles(which)
        one = ordered((line.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        line, at = (one >> np.uint64(44)).astype(np.int64), (one >> np.uint64(44 - 10) & np.uint64(1023)).astype(np.int64) * words * 64 >> 10
        odd = (np.bincount(line * words * 64 + at, minlength=len(which) * words * 64) & 1).astype(np.uint8).reshape(len(which), words * 64)
        return np.bincount(line, minlength=len(which)), np.packbits(odd, axis=1).view(np.int64)

    def text(self, i: int) -> str:
        return self.points[self.begin[i] : self.end[i]].tobytes().decode("utf-32-le")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, Lines]]:
    """The texts of a batch in slices, with the row at which each begins."""
    texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
    for i, j in kernels.slices(np.concatenate([[0], np.cumsum([len(x) for x in texts])]), 250_000):
        yield i, Lines(texts[i:j])


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h"))


def meetings(docs: DataFrame) -> DataFrame:
    """``key, tag, lead, n``: the lines that share a band key with other lines. The number of buckets follows the number of lines."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = docs.agg(F.coalesce(F.sum(breaks + 1), F.lit(0)).alias("n")).first().n
    buckets = meeting.buckets_for(lines * BANDS)

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in it:
            for _, x in _runs(batch):
                which = np.unique(x.key, return_index=True)[1]
                yield x.bands(x.bins(which)), x.key[which] >> np.uint64(32)

    return meeting.met(hashed(docs).mapInArrow(trimmed(lambda it: meeting.banded(parts(it), buckets)), "bucket int, entries binary"))


def tag_filter(tags: DataFrame) -> np.ndarray:
    """A bitmap of the tags, 8 MB whatever their number: never misses one, may let others through."""
    words = tags.selectExpr(f"shiftrightunsigned(xxhash64(tag), {64 - FILTER_BITS}) AS place").selectExpr("shiftrightunsigned(place, 6) AS w", "shiftleft(1L, cast(place % 64 AS int)) AS b")
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for part in words.groupBy("w").agg(F.bit_or("b").alias("b")).repartition(8).toArrow().to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    return out


def line_table(docs: DataFrame, wanted) -> DataFrame:
    """``doc_id, h, line_no, key, check`` of every line that is not blank; of lines whose tag the broadcast bitmap ``wanted`` may hold also ``r, n, p0.., line``.

    ``key`` and ``check`` are 128 bits of the line without white space at its
    ends; ``h`` is a hash of the row, which tells apart rows of equal doc_id; ``n``
    and ``p`` are the size and the short sketch of the line's set. ``r`` names a
    row that has them: one of several equal lines in a slice.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, x in _runs(batch):
                rows = pa.array(x.doc + at)
                tags = (x.key >> np.uint64(32)).astype(np.int64)
                place = xxhash64_of(tags) >> np.uint64(64 - FILTER_BITS)
                hit = (wanted.value[(place >> np.uint64(6)).astype(np.intp)] >> (place & np.uint64(63)).astype(np.int64)) & 1 == 1
                some = np.flatnonzero(hit)
                some = some[np.sort(np.unique(x.key[some], return_index=True)[1])]
                full = np.full(len(x.key), -1)
                full[some] = np.arange(len(some))
                take, h = pa.array(full, mask=full < 0), batch.column(2).take(rows)
                n, words = x.parities(some, SHORT)
                r = kernels.mixed(h.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x.number.astype(np.uint64))[some]
                candidate = [pa.array(r.view(np.int64)), pa.array(n.astype(np.int32)), *[pa.array(np.ascontiguousarray(w)) for w in words.T], pa.array([x.text(i) for i in some], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), h, pa.array(x.number.astype(np.int32)), pa.array(x.key.view(np.int64)), pa.array(x.check.view(np.int64)), *[c.take(take) for c in candidate]],
                    ["doc_id", "h", "line_no", "key", "check", "r", *CARRIED, "line"],
                )

    return hashed(docs).mapInArrow(trimmed(batches), f"doc_id long, h long, line_no int, key long, check long, r long, n int, {', '.join(f'{w} long' for w in CARRIED[1:])}, line string")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_of(values: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one 64-bit column: the published xxHash64 of eight bytes, seed 42."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    h = np.uint64(42) + _P5 + np.uint64(8) ^ turned(values.view(np.uint64) * _P2, 31) * _P1
    h = turned(h, 27) * _P1 + _P4
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def sketches(lines: DataFrame) -> DataFrame:
    """``id, n`` and a parity bitmap of the shingle set of each ``id, line``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = Lines(batch.column(1).to_pylist())
            n, words = x.parities(np.arange(len(x.key)), SKETCH)
            columns = [pa.array(n), *[pa.array(np.ascontiguousarray(words[:, k])) for k in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", *[f"p{k}" for k in range(SKETCH)]])

    return lines.mapInArrow(trimmed(batches), "id long, n long, " + ", ".join(f"p{k} long" for k in range(SKETCH)))


#: Columns of a candidate's size and short sketch.
CARRIED = ["n", *[f"p{k}" for k in range(SHORT)]]


def _possible(words: int) -> str:
    """What holds for any pair that links: sizes, and parity sketches (1/7 of both sets may differ at most)."""
    differing = " + ".join(f"bit_count(x_p{k} ^ y_p{k})" for k in range(words))
    return f"100 * least(x_n, y_n) >= {PERCENT} * greatest(x_n, y_n) and 7 * ({differing}) <= x_n + y_n"


#: The same before a pair's texts are fetched, and before sketched members are paired.
CHEAP, POSSIBLE = _possible(SHORT), _possible(SKETCH)


def linked(left: list[str], right: list[str], at_once: int = 200) -> list[bool]:
    """For each pair of lines, whether their shingle sets have a similarity of PERCENT in a hundred or more.

    At most 256 pairs go at once: nine bits tell their lines apart beside 55 bits of a shingle.
    """
    n = len(left)
    if n > at_once:
        return linked(left[:at_once], right[:at_once]) + linked(left[at_once:], right[at_once:])
    both = Lines([*left, *right])
    h, line = both.shingles(np.arange(len(both.key)))
    which = both.doc[line]
    sets = ordered((which.astype(np.uint64) << np.uint64(55)) | (h >> np.uint64(9)))
    sizes = np.bincount((sets >> np.uint64(55)).astype(np.int64), minlength=2 * n)
    cut_at = int(np.searchsorted(sets, np.uint64(n) << np.uint64(55)))
    merged = np.concatenate([sets[:cut_at], sets[cut_at:] - (np.uint64(n) << np.uint64(55))])
    merged.sort()
    inter = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> np.uint64(55)).astype(np.int64), minlength=n)
    return (100 * inter >= PERCENT * (sizes[:n] + sizes[n:] - inter)).tolist()


def _linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [x for at in range(0, len(left), 200) for x in linked(left[at : at + 200], right[at : at + 200])]
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


#: 2^62: a line's place in the order of classes is doc_id times this, and 30 bits of the row's hash above the line number.
_PLACES = "cast(4611686018427387904 as decimal(19,0))"
_REST = "shiftrightunsigned(h, 34) * 4294967296L + line_no"
_PLACE = f"coalesce(doc_id, {-(2**63)}L) * {_PLACES} + ({_REST})"


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, h, line_no, class_doc_id, class_line_no, kept`` for every line that is not blank.

    A class is a component of linked lines; equal lines (white space at the ends
    aside) always link. Its first line by doc_id (null first), row hash and line
    number stays. Null and blank texts have no rows; lines of fewer than five
    characters link to equal lines only. Repeated rows of one document share
    their decisions.

    Texts are read twice. The first pass sends eight bytes a band and line to
    the bucket of the band key, which names the lines that meet. The second
    writes each line's key, and the text of lines that met another one. A
    component is found without comparing all pairs of a band. Minima travel as
    one number each, so Spark combines them by hash before it shuffles.
    """
    spark = docs.sparkSession
    met = meetings(docs)
    wanted = spark.sparkContext.broadcast(tag_filter(met.select("tag").distinct()))
    lines = cut(line_table(docs, wanted))
    texts = lines.where("line is not null").select("r", "line")
    tag = F.shiftrightunsigned("key", 32)
    found = lines.where("line is not null").groupBy(F.col("key").alias("id"), tag.alias("tag")).agg(F.min("r").alias("r"), *[F.min(c).alias(c) for c in [*CARRIED, "check"]])
    some = cut(found)

    def linking(near: DataFrame) -> DataFrame:
        """Of ``a, b, r_a, r_b`` the pairs whose texts link."""
        near = cut(near)
        left = texts.join(near, F.col("r") == F.col("r_a")).select("a", "b", "r_b", F.col("line").alias("la"))
        right = texts.join(near.select(F.col("r_b").alias("r")).distinct(), "r", "left_semi").select(F.col("r").alias("r_b"), F.col("line").alias("lb"))
        return left.join(right, "r_b").select("a", "b", "la", "lb").mapInArrow(trimmed(_linked), "a long, b long")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = [some.select(F.col("id").alias(side), F.col("r").alias(f"r_{side}"), *[F.col(w).alias(f"{name}_{w}") for w in CARRIED]) for side, name in (("a", "x"), ("b", "y"))]
        return linking(pairs.join(a, "a").join(b, "b").where(CHEAP).select("a", "b", "r_a", "r_b"))

    def sketched(ids: DataFrame) -> DataFrame:
        return sketches(texts.join(some.join(ids, "id").select("id", "r"), "r").select("id", "line"))

    lists, pairs = meeting.first_round(met, some, CARRIED, CHEAP, ("r",))
    begun = lists, pairs.select("a", "b"), linking(pairs.where("near").select("a", "b", "r_a", "r_b"))
    labels = components(Links(None, verify, sketched, POSSIBLE, begun))

    firsts = cut(lines.select("key", "check", F.expr(_PLACE).alias("place")).groupBy("key", "check").agg(F.min("place").alias("place"), F.count("*").alias("n")))
    members = labels.join(some.select("id", "check"), "id").select(F.col("id").alias("key"), "check", "label")
    placed = cut(members.join(firsts.select("key", "check", "place"), ["key", "check"]))
    heads = placed.groupBy("label").agg(F.min("place").alias("head"))
    # A line that no other one equals or links to is its own class: it has no row here, and its place is not looked up.
    copies = firsts.where("n > 1").select("key", "check", F.col("place").alias("head")).join(placed.select("key", "check"), ["key", "check"], "left_anti")
    shared = placed.join(heads, "label").select("key", "check", "head").unionByName(copies)
    rest = f"pmod(head, {_PLACES})"
    parts = shared.selectExpr("key", "check", f"(head - {rest}) div {_PLACES} AS head_doc", f"cast({rest} AS long) AS head_rest")
    joined = lines.select("doc_id", "h", "line_no", "key", "check").join(parts, ["key", "check"], "left")
    alone = F.col("head_rest").isNull()
    return joined.select(
        "doc_id", "h", "line_no", F.when(alone, F.col("doc_id")).when(F.col("head_doc") != -(2**63), F.col("head_doc")).alias("class_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.expr("cast(head_rest & 4294967295L AS int)")).alias("class_line_no"),
        (alone | (F.expr(f"coalesce(doc_id, {-(2**63)}L) = head_doc and {_REST} = head_rest"))).alias("kept"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay: all rows and columns; ``text`` and ``n_chars``, if there, are new.

    Blank lines stay in a text that keeps a line. A text none of whose lines
    stays becomes empty; null text stays null. Of rows that repeat doc_id and
    text, one has the lines and the others are empty.
    """
    keep = classes(docs).where("kept").groupBy(F.col("h").alias("kept_h"), F.col("doc_id").alias("kept_id")).agg(F.collect_list("line_no").alias("kept_lines"))
    rows = docs.select(F.struct(*[quoted(c).alias(n) for c, n in zip(docs.columns, private(docs.columns), strict=True)]).alias("doc"), F.xxhash64("doc_id", "text").alias("h"), "doc_id")
    joined = rows.join(keep, (F.col("h") == F.col("kept_h")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left")
    copy = F.row_number().over(Window.partitionBy("h", "doc_id").orderBy("h"))
    kept_lines = F.when(copy == 1, F.col("kept_lines"))
    schema = docs.schema
    names = schema.names

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, kept = batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist()
            new = [None if x is None else "" if not k else rebuilt(x, set(k)) for x, k in zip(texts, kept, strict=True)]
            columns = [batch.column(i) for i in range(len(names))]
            columns[names.index("text")] = pa.array(new, batch.column(names.index("text")).type)
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if x is None else len(x) for x in new], batch.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select("doc.*", kept_lines.alias("kept")).mapInArrow(trimmed(batches), schema)


def rebuilt(text: str, kept: set[int]) -> str:
    """The text of its kept and blank lines."""
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i in kept or not line.strip(" \t\n\v\f\r"))
