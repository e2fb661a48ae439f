"""Document fingerprints by randomised edit embedding (operator 2).

A walk reads the text from its start. At step j it writes the character under
it and then stays or moves on by a random bit that depends on j and on the
character; all texts share the bits. Two walks that an edit has parted meet
again soon, so a few edits change few steps: edit distance becomes Hamming
distance. A fingerprint keeps one hexadecimal digit for each of ``DIGITS``
sampled steps. Banding takes samples of digits as keys; candidates are verified
on the whole fingerprint.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import kernels, meeting
from loomstone.llm.components import Links, components
from loomstone.llm.scratch import appended, cached, cut, trimmed

#: Sampled steps, a hexadecimal digit each.
DIGITS = 256
#: Steps for which the shared bits are drawn at once, and classes of characters; class 0 ends a text.
PERIOD, CLASSES = 4096, 256
#: Code points embedded at once, unless one text alone has more.
CHUNK = 4_000_000
#: Texts still going below which they are walked one by one.
SCALAR = 16
#: Bands, digits of a band, and the likeness from which two texts are near: 0.766 of their digits agree there,
#: and they meet in some band with probability 0.994.
BANDS, BAND_DIGITS, NEAR = 40, 8, 0.75
#: Words of 64 bits that hold a fingerprint.
WORDS = DIGITS // 16


@cached
@functools.lru_cache(maxsize=32)
def _bits(page: int) -> np.ndarray:
    """``[step, class]`` to the walk's move, for the ``PERIOD`` steps from ``page * PERIOD`` on: every step has bits of its own."""
    bits = np.random.default_rng([20, page]).integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
    bits[:, 0] = 0
    return bits


@functools.lru_cache(maxsize=1)
def _digits() -> np.ndarray:
    """``[sample, class]`` to a digit."""
    return np.random.default_rng(21).integers(0, 16, (DIGITS, CLASSES), dtype=np.uint8)


@functools.lru_cache(maxsize=4)
def _samples(octaves: int) -> dict[int, np.ndarray]:
    """Step to the samples that choose it, so far: each sample takes the last such step that a text's walk has.

    The steps of one sample are the running minima of a random order over all
    steps, so texts of nearly equal length share nearly all samples. Each octave
    of steps is drawn on its own: the same whatever the number of octaves.
    """
    out: dict[int, list[int]] = {}
    for k in range(DIGITS):
        best = 2.0
        for octave in range(octaves):
            low, high = (0, 1) if octave == 0 else (2 ** (octave - 1), 2**octave)
            rng = np.random.default_rng([22, k, octave])
            chain, least = [], 0.0
            while high > low:
                least = 1 - (1 - least) * (1 - rng.random()) ** (1 / (high - low))
                high = int(rng.integers(low, high))
                chain.append((high, least))
            for step, value in reversed(chain):
                if value < best:
                    best = value
                    out.setdefault(step, []).append(k)
    return {j: np.array(ks) for j, ks in out.items()}


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % (CLASSES - 1) + 1


def steps_of(n_chars: np.ndarray | int):
    """Steps of a walk: two a character, and some to spare so that nearly every walk reads the whole text."""
    return (2 * n_chars + 6 * np.sqrt(n_chars) + 4).astype(np.int64)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text. Texts are walked in step, longest first."""
    if not texts:
        return []
    parts = [_classes(x).astype(np.uint8) for x in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    walk = steps_of(lengths)
    buffer = np.zeros(int(lengths.sum()) + len(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.intp)
    for at, i in zip(starts, order, strict=True):
        buffer[at : at + len(parts[i])] = parts[i]
    del parts
    samples = _samples(int(walk[0]).bit_length() + 1)
    digit = _digits()
    spare = ((lengths[:, None] * 7 + np.arange(DIGITS)) & 15).astype(np.uint8)
    made = np.zeros((len(texts), DIGITS), np.uint8)
    place, going = starts.copy(), len(texts)
    seen = np.empty(going, np.uint8)
    move = np.empty(going, np.intp)
    for j in range(int(walk[0])):
        while going and walk[going - 1] <= j:
            going -= 1
        if going <= SCALAR:
            _walk_rest(buffer, place, walk, j, going, samples, digit, spare, made)
            break
        here = place[:going]
        c = buffer.take(here, out=seen[:going], mode="clip")
        chosen = samples.get(j)
        if chosen is not None:
            made[:going, chosen] = np.where(c[:, None] > 0, digit[chosen][:, c].T, spare[:going, chosen])
        if j % PERIOD == 0 or j == 0:
            bits = _bits(j // PERIOD).astype(np.intp)
        here += bits[j % PERIOD].take(c, out=move[:going], mode="clip")
    hexed = np.frombuffer(b"0123456789abcdef", np.uint8)[made]
    out = [""] * len(texts)
    for row, i in zip(hexed, order, strict=True):
        out[i] = row.tobytes().decode()
    return out


def _walk_rest(buffer, place, walk, begin, going, samples, digit, spare, made) -> None:
    """The few longest texts one by one."""
    marks = sorted(j for j in samples if j >= begin)
    for i in range(going):
        at, data, stop, next_mark = int(place[i]), memoryview(buffer), int(walk[i]), 0
        j = begin
        while j < stop:
            flat, base = bytes(_bits(j // PERIOD)), j - j % PERIOD
            page = min(stop, base + PERIOD)
            while j < page:
                if next_mark < len(marks) and marks[next_mark] == j:
                    c, ks = data[at], samples[j]
                    made[i, ks] = digit[ks, c] if c else spare[i, ks]
                    next_mark += 1
                to = min(page, marks[next_mark]) if next_mark < len(marks) else page
                for k in range((j - base) * CLASSES, (to - base) * CLASSES, CLASSES):
                    at += flat[k + data[at]]
                j = to


def likeness(a: str, b: str) -> float:
    """0 for unrelated fingerprints, 1 for equal ones: the share of equal digits, corrected for chance."""
    same = np.count_nonzero(np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)) / len(a)
    return max(0.0, (same - 1 / 16) / (15 / 16))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` of the whole text; null counts as empty. All rows stay, and all columns but one of that name."""

    def make(column: pa.Array):
        at = 0
        for part in chunks([x or "" for x in column.to_pylist()]):
            yield at, at + len(part), [pa.array(fingerprints(part), pa.string())]
            at += len(part)

    return appended(docs, text, {"fingerprint": "string"}, make, _bits)


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """``texts`` in runs of at most ``CHUNK`` code points."""
    run, n = [], 0
    for x in texts:
        if run and n + len(x) > CHUNK:
            yield run
            run, n = [], 0
        run.append(x)
        n += len(x)
    if run:
        yield run


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points is the first as many of the text that follows it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The next document is the one after it by doc_id (null first; equal ids by
    the hash of their text), and the first after the last; a single document is
    its own next. Null text counts as empty. Empty input gives no rows.

    Texts move once, into ranges of doc_id. A range's last row finds its next in
    a second, small step: each range passes on its first text and its last.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    small = keyed.select("doc_id", "h", "text").mapInArrow(trimmed(_shrunk), "doc_id long, h long, size long, text binary")
    ranged = small.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    schema = "kind string, doc_id long, h long, text string, fingerprint string, n_chars long, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"
    part = cut(ranged.mapInArrow(trimmed(_walk_range, _bits), schema))
    edges = part.where("kind in ('first', 'last')").select("kind", "doc_id", "h", "text", "fingerprint")
    rest = cut(edges.coalesce(1).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "kind").mapInArrow(trimmed(_walk_edges, _bits), schema))
    return part.where("kind = 'row'").unionByName(rest).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _rows(ids, hs, texts, prints, following, next_prints) -> pa.RecordBatch:
    """Finished rows: every text with the text that follows it."""
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new_prints: list[str] = []
    for run in chunks(new):
        new_prints += fingerprints(run)
    n = len(ids)
    return _batch(
        ["row"] * n, ids, hs, [None] * n, prints, [len(x) for x in texts], [hashlib.sha256(x.encode()).hexdigest() for x in new], new_prints,
        [likeness(a, b) for a, b in zip(prints, new_prints, strict=True)], [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)],
    )


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["kind", "doc_id", "h", "text", "fingerprint", "n_chars", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _edge(kind: str, doc_id, h, text: str, fp: str) -> pa.RecordBatch:
    return _batch([kind], [doc_id], [h], [text], [fp], [None], [None], [None], [None], [None])


def _shrunk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle: it writes them to disk once."""
    codec = pa.Codec("zstd")
    for batch in it:
        texts = [x.encode() for x in batch.column(2).to_pylist()]
        columns = [pa.array([len(x) for x in texts], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "h", "size", "text"])


def _grown(sizes: list[int], texts: pa.Array) -> Iterator[list[str]]:
    """The texts again, in runs of at most ``CHUNK`` bytes, or of one text."""
    codec = pa.Codec("zstd")
    for i, j in kernels.slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), CHUNK):
        yield [codec.decompress(x.as_py(), n, asbytes=True).decode() for x, n in zip(texts.slice(i, j - i), sizes[i:j], strict=True)]


def _walk_range(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range in order: all rows but the last are finished; first and last go on as edges."""
    held, begun = None, False
    for batch in it:
        ids, hs, sizes = (batch.column(i).to_pylist() for i in range(3))
        at = 0
        for run in _grown(sizes, batch.column(3)):
            prints = fingerprints(run)
            rows = list(zip(ids[at : at + len(run)], hs[at : at + len(run)], run, prints, strict=True))
            at += len(run)
            if not begun:
                begun = True
                yield _edge("first", *rows[0])
            rows = ([held] if held else []) + rows
            held = rows[-1]
            if len(rows) > 1:
                ready = [list(c) for c in zip(*rows[:-1], strict=True)]
                yield _rows(*ready, [r[2] for r in rows[1:]], [r[3] for r in rows[1:]])
    if held:
        yield _edge("last", *held)


def _walk_edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last texts of all ranges, in order: each last is followed by the next range's first."""
    first, last = None, None
    for batch in it:
        for kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == "last":
                last = row
                continue
            first = first or row
            if last:
                yield _rows([last[0]], [last[1]], [last[2]], [last[3]], [row[2]], [row[3]])
                last = None
    if last:
        yield _rows([last[0]], [last[1]], [last[2]], [last[3]], [first[2]], [first[3]])


def near_duplicates(docs: DataFrame, near: float = NEAR, bands: int = BANDS, digits: int = BAND_DIGITS) -> DataFrame:
    """``doc_id, class_id``: the smallest doc_id that near links reach, for every row with an id.

    Equal fingerprints form one class from the start. Each band samples
    ``digits`` of the digits as its key; within a band, a class is compared with
    the smallest of its key first, and only keys that still hold several classes
    afterwards are compared further. A link is a likeness of ``near`` or more.
    Texts shorter than the band is long still have all digits, so the empty text
    only meets itself.
    """
    prints = cut(fingerprint(docs.select("doc_id", "text")).select("doc_id", "fingerprint").where("doc_id is not null"))
    return prints.join(near_prints(prints, near, bands, digits), "fingerprint").select("doc_id", "class_id")


def _words(prints: list[str]) -> np.ndarray:
    """Fingerprints as words of 16 digits."""
    return np.frombuffer(bytes.fromhex("".join(prints)), ">u8").astype(np.uint64).reshape(-1, WORDS)


def _differing(words: range) -> str:
    """SQL: how many digits of two packed fingerprints differ in some of the words."""
    x = "(x_p{0} ^ y_p{0})"
    return " + ".join(f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & 1229782938247303441L)".format(k) for k in words)


def hashes(fingerprint: str = "fingerprint") -> list:
    """128 bits that name a fingerprint."""
    return [F.xxhash64(fingerprint).alias("h1"), F.xxhash64(F.lit(1), fingerprint).alias("h2")]


def near_prints(prints: DataFrame, near: float = NEAR, bands: int = BANDS, digits: int = BAND_DIGITS) -> DataFrame:
    """``fingerprint, class_id`` of every fingerprint of ``doc_id, fingerprint`` rows, none of them null: see ``near_duplicates``."""
    named = near_classes(prints, near, bands, digits)
    return prints.select("fingerprint", *hashes()).distinct().join(named, ["h1", "h2"]).select("fingerprint", "class_id")


def near_classes(prints: DataFrame, near: float = NEAR, bands: int = BANDS, digits: int = BAND_DIGITS) -> DataFrame:
    """``h1, h2, class_id``: the same by the fingerprint's 128-bit name.

    Eight bytes a band and fingerprint name those that meet. A pair's likeness is
    counted on packed words where its sides meet, so only pairs that link go on.
    """
    chosen = np.random.default_rng(23)
    picks = [sorted(int(x) for x in chosen.choice(DIGITS, digits, replace=False)) for _ in range(bands)]
    most = DIGITS - int(np.ceil((near * 15 / 16 + 1 / 16) * DIGITS))
    words = [f"p{k}" for k in range(WORDS)]

    def wide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            w = _words(batch.column(3).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(c)) for c in w.T]], ["doc_id", "h1", "h2", *words])

    spread = prints.select("doc_id", *hashes(), "fingerprint").mapInArrow(trimmed(wide), f"doc_id long, h1 long, h2 long, {', '.join(f'{w} long' for w in words)}")
    reps = cut(spread.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), *[F.first(w).alias(w) for w in words]))
    nodes = reps.select(F.col("h1").alias("id"), F.shiftrightunsigned("h1", 32).alias("tag"), *words)
    buckets = meeting.buckets_for(reps.count() * bands)

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in it:
            w = np.stack([batch.column(2 + k).to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
            digit = np.stack([w[:, d // 16] >> np.uint64(60 - d % 16 * 4) & np.uint64(15) for d in range(DIGITS)], axis=1)
            made = np.empty((len(w), bands), np.uint64)
            for b, pick in enumerate(picks):
                key = np.full(len(w), b + 1, np.uint64)
                for d in pick:
                    key = (key << np.uint64(4)) + digit[:, d]
                made[:, b] = kernels.mixed(key)
            yield made, batch.column(1).to_numpy().view(np.uint64)

    met = meeting.met(nodes.mapInArrow(trimmed(lambda it: meeting.banded(keys(it), buckets)), "bucket int, entries binary"))
    whole = f"({_differing(range(WORDS))}) <= {most}"

    def verify(pairs: DataFrame) -> DataFrame:
        def side(name: str, prefix: str) -> DataFrame:
            return nodes.select(F.col("id").alias(name), *[F.col(w).alias(f"{prefix}_{w}") for w in words])

        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(whole).select("a", "b")

    # Pairs with leaders meet their words by tag, so they are verified on the spot.
    lists, pairs = meeting.first_round(met, nodes, words, whole)
    begun = lists, pairs.select("a", "b"), pairs.where("near").select("a", "b")
    labels = cut(components(Links(None, verify, lambda ids: nodes.join(ids, "id").select("id", *words), whole, begun)))
    heads = labels.join(reps.select(F.col("h1").alias("id"), "doc_id"), "id").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = labels.join(heads, "label").select(F.col("id").alias("h1"), "class_id")
    return reps.select("h1", "h2", "doc_id").join(named, "h1", "left").select("h1", "h2", F.coalesce("class_id", "doc_id").alias("class_id"))


def with_classes(docs: DataFrame) -> DataFrame:
    """``with_next`` and ``class_id`` of ``near_duplicates``, from one walk of the texts; null where doc_id is."""
    rows = with_next(docs)
    classes = near_classes(rows.where("doc_id is not null").select("doc_id", "fingerprint"))
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")
    return rows.select("*", *hashes()).join(classes, ["h1", "h2"], "left").select(*rows.columns, class_id)
