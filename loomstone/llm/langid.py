"""Language identification by cross-parsing entropy (operator 3).

A suffix automaton of labelled text per language yields longest matches. A text
is parsed greedily into the longest phrases that the labelled text holds; each
language's phrase count is normalised by text length and by the logarithm of
its labelled text's length, and the language that needs fewest wins.
"""

from __future__ import annotations

import functools
import math
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm import kernels
from loomstone.llm.scratch import appended, cached

#: Labelled texts read per language, and characters of them kept: the bounds of the fitted sample.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 30_000
#: Bytes of text that are parsed at once, unless one text alone has more.
SLICE = 8_000_000
#: Letters with one symbol each where there are over twice as many letters; the others are written as two symbols.
SINGLE = 94
#: Prediction for a text that is null or has no letter.
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class SuffixAutomaton:
    """States of all substrings of a sequence of small integers."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def steps(self, alphabet: int) -> np.ndarray:
        """``[state, symbol]`` to ``2 * next + 1`` where the symbol begins a phrase, else ``2 * next``.

        State 0 stands before a phrase; a symbol that the text lacks leads back to it.
        """
        root = np.array([2 * self.next[0].get(c, 0) + 1 for c in range(alphabet)], np.int32)
        table = np.tile(root, (len(self.next), 1))
        inner = self.next[1:]
        states = np.repeat(np.arange(1, len(self.next)), [len(x) for x in inner])
        symbols = np.array([c for x in inner for c in x], np.int64)
        table[states, symbols] = 2 * np.array([t for x in inner for t in x.values()], np.int32)
        return table


class Parser:
    """Phrase counts of texts under every language at once.

    Every letter of the samples is told apart: frequent ones have a symbol each,
    and where there are many letters the rest are written as two symbols. A
    language's automaton has columns for its own symbols only: 0 stands for a
    run of non-letters, 1 for all that its sample lacks, which ends a phrase
    there whatever it is. So the tables grow with the samples, not with
    languages times letters.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = _lower_letters()
        points = {k: letters[code_points(samples[k])] for k in self.langs}
        own, counts = np.unique(np.concatenate([p[p > 0] for p in points.values()] or [np.zeros(0, np.uint32)]), return_counts=True)
        own = own[np.lexsort((own, -counts))]
        single = len(own) if len(own) <= 2 * SINGLE else SINGLE
        self.base = max(1, math.ceil(math.sqrt(len(own) - single)))
        self.pair = 2 + single
        symbol = np.ones(sys.maxunicode + 1, np.int32)
        symbol[0] = 0
        symbol[own] = np.arange(2, 2 + len(own))
        self.symbol = symbol[letters]
        alphabet = self.pair + (2 * self.base if single < len(own) else 0)
        steps, self.columns, self.roots, self.scale, at = [], [], [], [], 0
        for k in self.langs:
            sequence = self._symbols(samples[k])
            seen = np.unique(sequence[sequence > 1])
            column = np.ones(alphabet, np.int64)
            column[0], column[seen] = 0, np.arange(2, 2 + len(seen))
            part = SuffixAutomaton(column[sequence].tolist()).steps(2 + len(seen))
            width = part.shape[1]
            # Of a state: the place of its row in one table of all languages, in place of its number.
            steps.append(((part >> 1).astype(np.int64) * width + at) * 2 + (part & 1))
            self.columns.append(column)
            self.roots.append(at)
            self.scale.append(math.log2(len(sequence) + 2))
            at += part.size
        self.columns = np.stack(self.columns) if self.columns else np.zeros((0, 2), np.int64)
        self.table = np.concatenate([x.ravel() for x in steps]) if steps else np.zeros(0, np.int64)
        if at * 2 < 2**31:
            self.table = self.table.astype(np.int32)

    def _symbols(self, text: str) -> np.ndarray:
        s = self.symbol[code_points(text)]
        s = s[(s > 0) | np.append(True, s[:-1] > 0)]
        if len(s) and int(s.max()) >= self.pair:
            rare = s >= self.pair
            at = np.flatnonzero(rare) + np.arange(np.count_nonzero(rare))
            high, low = np.divmod(s[rare] - self.pair, self.base)
            s = np.repeat(s, np.where(rare, 2, 1))
            s[at], s[at + 1] = self.pair + high, self.pair + self.base + low
        return s.astype(np.uint8) if self.pair + 2 * self.base <= 256 else s

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``phrases[language, text]`` and the parsed length of each text; 0 where it has no letter.

        Texts are read in step, longest first, so each step reads one symbol of
        every text that goes on.
        """
        parsed = [self._symbols(x) for x in texts]
        lengths = np.array([len(p) if p.any() else 0 for p in parsed], np.int64)
        order = np.argsort(-lengths, kind="stable")
        phrases = np.zeros((len(self.langs), len(texts)), np.int64)
        going = lengths[order]
        n = int(np.searchsorted(-going, 0))
        if not n or not self.langs:
            return phrases, lengths
        order, going = order[:n], going[:n]
        buffer = np.concatenate([parsed[i] for i in order])
        at = np.append(0, np.cumsum(going))[:-1].astype(np.intp)
        state = np.repeat(np.array(self.roots, np.int64)[:, None], n, axis=1)
        done = np.zeros((len(self.langs), n), np.int64)
        alive = np.searchsorted(-going, -np.arange(going[0]), side="left") if going[0] < 2**22 else None
        for t in range(int(going[0])):
            k = int(alive[t]) if alive is not None else int(np.searchsorted(-going, -t, side="left"))
            if k < state.shape[1]:
                phrases[:, order[k : state.shape[1]]] = done[:, k:]
                if k <= SCALAR:
                    self._rest(buffer, at[:k], going[:k], t, state[:, :k], done[:, :k], phrases, order)
                    return phrases, lengths
                state, done, at = np.ascontiguousarray(state[:, :k]), np.ascontiguousarray(done[:, :k]), at[:k]
            value = self.table.take(state + self.columns.take(buffer.take(at + t), axis=1))
            done += value & 1
            state = value >> 1
        phrases[:, order[: state.shape[1]]] = done
        return phrases, lengths

    def _rest(self, buffer, at, going, t, state, done, phrases, order) -> None:
        """The few longest texts one by one: less work than steps of a few elements."""
        table = memoryview(self.table)
        for i in range(len(at)):
            symbols = buffer[at[i] + t : at[i] + going[i]].tolist()
            for lang in range(len(self.langs)):
                s, n = int(state[lang, i]), int(done[lang, i])
                column = self.columns[lang].tolist()
                for c in map(column.__getitem__, symbols):
                    v = table[s + c]
                    n += v & 1
                    s = v >> 1
                phrases[lang, order[i]] = n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text.

        The score is the runner-up's share of the two best languages' normalised
        counts: 0.5 for a tie up towards 1; 1 if only one language was learned,
        0 for ``und``. Ties go to the first language in code point order.
        """
        phrases, lengths = self.counts([x or "" for x in texts])
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rate = phrases * np.array(self.scale)[:, None] / np.maximum(lengths, 1)
        best = rate.argmin(axis=0)
        two = np.sort(rate, axis=0)[:2]
        score = two[1] / np.maximum(two.sum(axis=0), 1e-300) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if n else UNDETERMINED for b, n in zip(best, lengths, strict=True)], np.where(lengths > 0, score, 0.0)


#: Texts still going below which they are read one by one.
SCALAR = 6


@cached
@functools.lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def fit(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text per language from the rows where ``learn`` holds and lang is not null.

    Bounded by ``rows`` distinct texts a language, drawn in the order of their
    hashes so that copies count once, and by ``chars`` characters, which the drawn
    texts share: a text gives its beginning up to an equal share, and what a
    shorter one leaves goes to the longer ones.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    drawn = labelled.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).drop("n")
    # No text gives more than ``chars`` characters, so no more of it comes to the driver.
    begun = F.substring("text", 1, chars).alias("text")
    texts = docs.where(learn).select("lang", begun, F.xxhash64("text").alias("h")).join(F.broadcast(drawn), ["lang", "h"])
    kept = texts.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    of: dict[str, list[str]] = {}
    for r in sorted(kept, key=lambda r: (r.lang, r.h)):
        of.setdefault(r.lang, []).append(r.text)
    return {lang: _shared_out(texts, chars) for lang, texts in of.items()}


def _shared_out(texts: list[str], chars: int) -> str:
    """The texts' beginnings, ``chars`` characters together with the spaces between them."""
    left, take = max(0, chars - (len(texts) - 1)), [0] * len(texts)
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        take[i] = min(len(texts[i]), left // (len(texts) - done))
        left -= take[i]
    return " ".join(x[:n] for x, n in zip(texts, take, strict=True))


def identify(docs: DataFrame, samples: dict[str, str], pred: str = "lang_pred", certainty: str = "lang_score") -> DataFrame:
    """Adds columns ``pred`` and ``certainty`` from the whole text alone; null text or none with a letter is ``und``.

    Any rows and columns are kept, but that input columns of those two names are
    replaced; no shuffle. Each worker builds the automata once from the bounded
    samples, which travel with the function.
    """
    model = tuple(sorted(samples.items()))

    def make(column: pa.Array):
        _, offsets = kernels.utf8(column)
        for i, j in kernels.slices(offsets, SLICE):
            lang, score = _parser(model).predict(column.slice(i, j - i).to_pylist())
            yield i, j, [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return appended(docs, "text", {pred: "string", certainty: "double"}, make, _parser)
