"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 6).

A text longer than a leaf is cut in half, each half is encoded, and the halves
are joined: only a window at the boundary is encoded again, and it grows until
the tokens outside it provably stay.

The pattern cuts a text into matches from its start, and each match is encoded
on its own. Three facts bound the window. A match depends on the text from its
start to ``REACH`` characters past it at most, so matches of the left half that
end two characters before the boundary are matches of the whole. Matching on
from the last of them, the first place where a match of the whole and a match
of the right half both begin ends the window: from there on the two are the
same. And inside one match that spans the boundary, a sequence of tokens is the
encoding of its bytes exactly when each neighbouring pair is the encoding of
its own bytes; so two long parts of one match are joined by a window of tokens
that grows until the pairs at both of its edges pass that test.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark.sql import DataFrame

from loomstone.llm import kernels
from loomstone.llm.scratch import appended, cached

#: File name, in the folder of public tokenizers, of the default ranks.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points that are encoded at once at the bottom of the tree.
LEAF = 512
#: Ids that are decoded at once at the bottom of the tree.
DECODE_LEAF = 8192
#: Characters past its start that a match of three letters or fewer looks at; others look one past their end.
REACH = 3
#: Match starts that a segment knows at either end.
KNOWN = 3
#: Characters of a match above which its two parts are joined by tokens.
LONG = 64
#: Bytes of text whose rows one Arrow batch of results holds, unless one text alone has more.
SLICE = 4_000_000


@cached
@functools.lru_cache(maxsize=1)
def alphabet(pattern: str) -> np.ndarray:
    """For each code point one that this process's regular expressions class as the library classes the first.

    The two engines know different versions of Unicode. ASCII stands for itself
    where they agree; any other code point becomes a fixed one that belongs to
    the same of the pattern's classes in both engines.
    """
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    bytes_only = {bytes([i]): i for i in range(256)}
    theirs, ours = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
    for k, name in enumerate(sorted({c.replace("P", "p").replace("S", "s") for c in regex.findall(r"\\[pP]\{[^}]*\}|\\[sS]", pattern)})):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=bytes_only, special_tokens={})
        for masks, found in ((theirs, bytes(probe.encode_ordinary(every)).decode()), (ours, "".join(regex.findall(name, every)))):
            masks[np.frombuffer(found.encode("utf-32-le"), np.uint32)] |= 1 << k
    table = np.arange(0x110000, dtype=np.uint32)
    for mask in np.unique(theirs[points]):
        alike = points[(points >= 128) & (theirs[points] == mask) & (ours[points] == mask)]
        mine = points[theirs[points] == mask]
        table[mine[(mine >= 128) | (ours[mine] != mask)]] = alike[0]
    return table


@dataclass
class Segment:
    """Text ``[start, end)`` with its ids, encoded as if it stood alone.

    ``head`` has the first match starts with the number of ids before each,
    ``tail`` the last match starts with the number of ids from each one on.
    """

    start: int
    end: int
    ids: np.ndarray
    head: list[tuple[int, int]]
    tail: list[tuple[int, int]]


class TreeEncoder:
    """Encodes as the tiktoken library does with the same ranks and pattern, by tree reduction."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.core = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = max(2, leaf)
        self.matches, self.alphabet = regex.compile(pattern), alphabet(pattern)
        self.odd = [chr(c) for c in np.flatnonzero(self.alphabet[:128] != np.arange(128))]
        self.piece = {v: k for k, v in ranks.items()}
        self._fits: dict[tuple[int, int], bool] = {}

    def _one(self, part: str) -> list[int]:
        """Ids of one match."""
        return self.core._encode_single_piece(part)

    def shape(self, text: str) -> str:
        """The text in the characters of ``alphabet``: what the pattern is matched on."""
        if text.isascii() and not any(c in text for c in self.odd):
            return text
        return self.alphabet.take(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tobytes().decode("utf-32-le")

    def _ends(self, shape: str, at: int, end: int) -> Iterator[int]:
        """Ends of the matches from ``at`` on."""
        while at < end:
            at = self.matches.match(shape, at, end).end()
            yield at

    def _leaf(self, text: str, shape: str, start: int, end: int) -> Segment:
        ids = np.asarray(self.core.encode_ordinary(text[start:end]), dtype=np.uint32)
        if end - start == len(text):
            return Segment(start, end, ids, [], [])  # nothing joins it
        head, n, at = [(start, 0)], 0, start
        for stop in self._ends(shape, start, end):
            if len(head) == KNOWN or stop == end:
                break
            n += len(self._one(text[at:stop]))
            head.append((stop, n))
            at = stop
        # A space after something else begins a match, whatever stands to the left.
        near = text.rfind(" ", start + 1, max(start + 1, end - 2 * KNOWN))
        while near > start and shape[near - 1].isspace():
            near = text.rfind(" ", start + 1, near)
        begins = [max(near, start)]
        begins += [stop for stop in self._ends(shape, begins[0], end) if stop < end]
        tail, n = [], 0
        for at, stop in zip(reversed(begins), [end, *reversed(begins)], strict=False):
            n += len(self._one(text[at:stop]))
            tail.append((at, n))
            if len(tail) == KNOWN:
                break
        return Segment(start, end, ids, head, tail[::-1])

    def fits(self, left: int, right: int) -> bool:
        """Whether the pair is the encoding of its bytes."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 50_000:
                self._fits.clear()
            known = self._fits[key] = self.core._encode_single_piece(self.piece[left] + self.piece[right]) == [left, right]
        return known

    def join_match(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joins the ids of two parts of one match."""
        window = 4
        while True:
            i, j = min(window, len(left)), min(window, len(right))
            a, b = left[len(left) - i :].tolist(), right[:j].tolist()
            middle = self.core._encode_single_piece(b"".join(self.piece[t] for t in a + b))
            fine_left = i == len(left) or self.fits(int(left[len(left) - i - 1]), middle[0])
            fine_right = j == len(right) or self.fits(middle[-1], int(right[j]))
            if fine_left and fine_right:
                return np.concatenate([left[: len(left) - i], np.asarray(middle, dtype=np.uint32), right[j:]])
            window *= 2

    def join(self, text: str, shape: str, a: Segment, b: Segment) -> Segment:
        """The segment of both: ids before the window and after it stay."""
        m, end = a.end, b.end
        begin, kept = next(((t, n) for t, n in reversed(a.tail) if t <= m - 2), (a.start, len(a.ids)))
        # Matches of the whole from the window's begin, until one ends where a match of the right half does.
        rights = iter([*b.head[1:], None])
        right, counted = b.head[0]
        ends, at = [], begin
        following = self._ends(shape, begin, end)
        later = None
        while at != right:
            if at < right:
                at = next(following)
                ends.append(at)
                continue
            known = next(rights, None) if later is None else None
            if known is not None:
                right, counted = known
            else:
                later = later or self._ends(shape, right, end)
                stop = next(later)
                counted += len(self._one(text[right:stop]))
                right = stop
        if right == end:
            counted = len(b.ids)
        middle, starts, total = [], [], 0
        at = begin
        for stop in ends:
            starts.append((at, total))
            if stop - at > LONG and at == a.tail[-1][0] < m < stop and stop == (b.head[1][0] if len(b.head) > 1 else end):
                ids = self.join_match(a.ids[len(a.ids) - a.tail[-1][1] :], b.ids[: b.head[1][1] if len(b.head) > 1 else len(b.ids)])
            else:
                ids = np.asarray(self._one(text[at:stop]), dtype=np.uint32)
            middle.append(ids)
            total += len(ids)
            at = stop
        before, after = len(a.ids) - kept, len(b.ids) - counted
        ids = np.concatenate([a.ids[:before], *middle, b.ids[counted:]])
        inner = [(t, before + n) for t, n in starts]
        head = [x for x in a.head if x[0] < begin] + inner + [(t, n - counted + before + total) for t, n in b.head if right <= t < end]
        tail = [(t, n - kept + total + after) for t, n in a.tail if t < begin] + [(t, len(ids) - n) for t, n in inner] + [x for x in b.tail if x[0] >= right]
        return Segment(a.start, end, ids, head[:KNOWN], tail[-KNOWN:])

    def _tree(self, text: str, shape: str, start: int, end: int) -> Segment:
        if end - start <= self.leaf:
            return self._leaf(text, shape, start, end)
        middle = (start + end) // 2
        return self.join(text, shape, self._tree(text, shape, start, middle), self._tree(text, shape, middle, end))

    def encode(self, text: str) -> np.ndarray:
        return self._tree(text, self.shape(text), 0, len(text)).ids if text else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return self.core.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@cached
@functools.lru_cache(maxsize=1)
def encoder(path: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> TreeEncoder:
    """One encoder per worker process; the defaults are the public vocabulary and its pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return TreeEncoder(ranks, pattern or public_tokenizers.PATTERN, leaf)


def _made(convert, kinds: list[pa.DataType]):
    """New columns from what ``convert`` makes of each value, in slices of ``SLICE`` bytes."""

    def make(column: pa.Array):
        sizes = pyarrow.compute.fill_null(pyarrow.compute.binary_length(column), 0)
        for i, j in kernels.slices(np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)]), SLICE):
            made = [convert(x.as_py()) for x in column.slice(i, j - i)]
            yield i, j, [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]

    return make


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Adds ``ids``: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    Null text encodes as the empty text: no ids. Rows, their order within a
    partition and all other columns stay; a column ``ids`` of the input is
    replaced. No shuffle; memory holds one Arrow batch, a slice's results and
    one tree.
    """
    return appended(df, text, {ids: "binary"}, _made(lambda x: (encoder(path, pattern, leaf).encode(x or "").astype("<u4").tobytes(),), [pa.binary()]), encoder, alphabet)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``decoded``: the bytes that the packed ids stand for. Null ids decode to no bytes."""
    return appended(df, ids, {decoded: "binary"}, _made(lambda x: (encoder(path, pattern).decode(np.frombuffer(x or b"", "<u4")),), [pa.binary()]), encoder, alphabet)


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``encode`` and ``decode`` of the packed ids, in one Python stage."""

    def both(x: str | None) -> tuple[bytes, bytes]:
        tree = encoder(path, pattern, leaf)
        packed = tree.encode(x or "").astype("<u4").tobytes()
        return packed, tree.decode(np.frombuffer(packed, "<u4"))

    return appended(df, text, {ids: "binary", decoded: "binary"}, _made(both, [pa.binary(), pa.binary()]), encoder, alphabet)


def verified(df: DataFrame, text: str = "text", ids: str = "ids", decodes: str = "decodes", path: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``encode`` and whether the packed ids decode to the text's bytes; the decoded bytes stay in the worker."""

    def both(x: str | None) -> tuple[bytes, bool]:
        tree = encoder(path, pattern, leaf)
        packed = tree.encode(x or "").astype("<u4").tobytes()
        return packed, tree.decode(np.frombuffer(packed, "<u4")) == (x or "").encode()

    return appended(df, text, {ids: "binary", decodes: "boolean"}, _made(both, [pa.binary(), pa.bool_()]), encoder, alphabet)
