"""Periodic runs of words by recompression.

*Grammar.*  The words of the texts of one slice stand in one array, with a mark of
its own between neighbours.  Two steps alternate until every text is a few symbols:
equal neighbours become one symbol (block compression), and pairs of a left and a
right symbol become one (pair compression; the side of a symbol is a hash bit of
the round).  Each step names what it makes by its parts alone, so equal stretches
get equal symbols but for a bounded fringe at their ends.  The levels form a
run-length grammar whose height is logarithmic in the longest text.

*Common extensions.*  How far two positions agree, to the right or to the left, is
read off the grammar: equal symbols are stepped over, a level higher each time both
sides stand at the edge of a parent, then a level lower each time they differ.  All
queries climb together, as arrays.

*Candidates.*  A run of period q and length >= max(24, 3q) repeats over more than 2q
words, so it holds two neighbouring points of the grid 0, q, 2q, ... with equal words
for the q + 1 words from the first on.  All grids of a text have n ln n points; a few
words of each are compared, and the points that pass are extended both ways by the
grammar, those inside a stretch that is already known being left out.  Only texts
with such points enter the grammar.  Of the periods of one stretch the least is kept.

Words are told apart exactly (numbered by a dictionary of the slice), texts are whole,
memory follows the slice (about ``SLICE_BYTES`` of text, or one long text).

Defined results: a null, empty or blank text has no words and no runs, and collapses
to an empty text; repeated rows and rows without an id get a row each; other columns
are not read; no rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

MIN_LENGTH, MIN_EXPONENT = 24, 3
SLICE_BYTES = 8 << 20
#: Grid points compared at once.
GRID_POINTS = 1 << 20
#: Rounds that drop the points of known stretches before the next one is extended.
ROUNDS = 12

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


# ---------------------------------------------------------------------------
# Grammar
# ---------------------------------------------------------------------------
def named(key: np.ndarray) -> np.ndarray:
    """Equal keys by one number."""
    return np.unique(key, return_inverse=True)[1].reshape(-1).astype(np.int64)


class Grammar:
    """Run-length grammar of an array of symbols.  Marks are the symbols below 0,
    each of which occurs once; the first and the last symbol are marks."""

    def __init__(self, symbols: np.ndarray, few: int = 4):
        self.symbol = [symbols]  # of each level
        self.up: list[np.ndarray] = []  # parent of each symbol of a level
        self.first: list[np.ndarray] = []  # first child of each symbol of the next level, and the end
        self.block: list[bool] = []
        seed = 0
        while self._longest() > few:
            for step in (self._blocks, self._pairs):
                keep, key = step(self.symbol[-1], seed)
                if keep.all():
                    continue
                first = np.flatnonzero(keep)
                self.up.append((np.cumsum(keep) - 1).astype(np.int64))
                self.first.append(np.append(first, len(keep)))
                self.block.append(step == self._blocks)
                below = self.symbol[-1][first]
                mark = below < 0
                made = np.empty(len(first), np.int64)
                made[mark] = below[mark]
                made[~mark] = named(key[first][~mark])
                self.symbol.append(made)
            seed += 1

    def _longest(self) -> int:
        return int(np.diff(np.flatnonzero(self.symbol[-1] < 0)).max(initial=0))

    @staticmethod
    def _blocks(s: np.ndarray, seed: int):
        """(symbol starts a parent, name of that parent): equal neighbours together."""
        keep = np.ones(len(s), bool)
        keep[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(keep)
        key = np.zeros(len(s), np.int64)
        key[at] = (s[at] << 32) | np.diff(np.append(at, len(s)))
        return keep, key

    @staticmethod
    def _pairs(s: np.ndarray, seed: int):
        """The same for pairs of a left and a right symbol, sides as give more pairs."""
        side = C.mixed(s.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)
        word = s >= 0
        both = word[:-1] & word[1:]
        a, b = both & (side[:-1] < side[1:]), both & (side[:-1] > side[1:])
        pair = a if a.sum() >= b.sum() else b
        keep = np.ones(len(s), bool)
        keep[1:] = ~pair
        key = s.copy()
        key[:-1][pair] |= (s[1:][pair] + 1) << 32
        return keep, key

    def extension(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """Number of equal symbols from positions i and j on, to the right (step 1) or
        to the left (step -1), both positions included; i and j differ."""
        a, b = i.astype(np.int64), j.astype(np.int64)
        stop = np.full(len(a), len(self.up))  # level where the sides differed
        climbing = np.arange(len(a))
        for h in range(len(self.up)):
            at = climbing
            going = []
            while len(at):
                edge = self._edge(h, a[at], step) & self._edge(h, b[at], step)
                going.append(at[edge])
                at = at[~edge]
                same = self.symbol[h][a[at]] == self.symbol[h][b[at]]
                stop[at[~same]] = h
                at = at[same]
                self._advance(h, a, b, at, step)
            climbing = np.concatenate(going) if going else climbing[:0]
            a[climbing], b[climbing] = self.up[h][a[climbing]], self.up[h][b[climbing]]
        for h in range(len(self.up), -1, -1):
            at = all_here = np.flatnonzero(stop >= h)
            while len(at):
                at = at[self.symbol[h][a[at]] == self.symbol[h][b[at]]]
                self._advance(h, a, b, at, step)
            if h:
                f = self.first[h - 1]
                for x in (a, b):
                    x[all_here] = f[x[all_here]] if step > 0 else f[x[all_here] + 1] - 1
        return (a - i) * step

    def _edge(self, h: int, x: np.ndarray, step: int) -> np.ndarray:
        p, f = self.up[h][x], self.first[h]
        return f[p] == x if step > 0 else f[p + 1] - 1 == x

    def _advance(self, h: int, a: np.ndarray, b: np.ndarray, at: np.ndarray, step: int) -> None:
        """Step over the equal symbols of queries ``at``: one, or what both sides have left of a block."""
        n = 1
        if h < len(self.up) and self.block[h] and len(at):
            f, left = self.first[h], []
            for x in (a[at], b[at]):
                p = self.up[h][x]
                left.append(f[p + 1] - x if step > 0 else x - f[p] + 1)
            n = np.minimum(*left)
        a[at] += n * step
        b[at] += n * step


# ---------------------------------------------------------------------------
# Runs
# ---------------------------------------------------------------------------
def grid_points(words: np.ndarray, first: np.ndarray, least: int, times: int):
    """(unit, text, period, position) of the grid points from which ``period + 1`` words
    may recur one period on: a few of them do.  A unit is one period of one text."""
    n = np.diff(first)
    top = np.where(n >= least, n // times, 0)  # greatest period of each text
    text = np.repeat(np.arange(len(n)), top)
    q = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    count = (n[text] - 1) // q - 1  # points with two more after them
    upto = np.cumsum(count)
    out, lo = [(np.zeros(0, np.int64),) * 2], 0
    while lo < len(q):
        before = upto[lo] - count[lo]
        hi = max(lo + 1, int(np.searchsorted(upto, before + GRID_POINTS, "right")))
        some = count[lo:hi]
        unit = np.repeat(np.arange(lo, hi), some)
        period = q[unit]
        at = first[text[unit]] + (np.arange(len(unit)) - np.repeat(upto[lo:hi] - some - before, some)) * period
        for offset in (lambda p: 0, lambda p: 1, lambda p: p >> 1, lambda p: p, lambda p: p - 1):
            here = at + offset(period)
            hit = words[here] == words[here + period]
            unit, period, at = unit[hit], period[hit], at[hit]
        out.append((unit, at))
        lo = hi
    unit, at = (np.concatenate(x) for x in zip(*out))
    return unit, text[unit], q[unit], at


def runs(words: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH, times: int = MIN_EXPONENT):
    """(text, start in the text, length, period) of all runs, in this order.

    words: numbers of the words of all texts; first: index of each text's first word, and the end."""
    unit, text, q, at = grid_points(words, first, least, times)
    if not len(unit):
        return (np.zeros(0, np.int64),) * 4
    used = np.unique(text)
    size = np.diff(first)[used] + 1
    begin = np.cumsum(size) - size + 1  # of each used text among its marks
    symbols = np.empty(int(size.sum()) + 1, np.int64)
    mark = np.append(begin - 1, len(symbols) - 1)
    inside = np.ones(len(symbols), bool)
    inside[mark] = False
    symbols[mark] = -1 - np.arange(len(mark))
    symbols[inside] = np.concatenate([words[first[t]:first[t + 1]] for t in used])
    grammar = Grammar(symbols)
    shift = np.zeros(len(first), np.int64)
    shift[used] = begin - first[used]
    at = at + shift[text]

    found = []
    known = np.zeros(int(unit[-1]) + 1, np.int64)  # points before this lie in a stretch that is known
    left = np.arange(len(unit))
    for round_ in range(ROUNDS + 1):
        left = left[at[left] >= known[unit[left]]]
        if not len(left):
            break
        pick = left
        if round_ < ROUNDS:
            pick = left[np.append(True, unit[left][1:] != unit[left][:-1])]
        for lo in range(0, len(pick), GRID_POINTS):
            some = pick[lo:lo + GRID_POINTS]
            i, p = at[some], q[some]
            after, before = grammar.extension(i, i + p, 1), grammar.extension(i - 1, i + p - 1, -1)
            known[unit[some]] = i + after
            length = after + before + p
            ok = length >= np.maximum(least, times * p)
            found.append(np.stack([text[some], i - before - shift[text[some]] - first[text[some]], length, p], 1)[ok])
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)  # the least period of each stretch
    rows = rows[new]
    return tuple(rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))].T)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def numbered(texts: list[str | None]):
    """(numbers of the words of all texts, index of each text's first word and the end, words by number)."""
    numbers, parts, counts = _Numbers(), [], [0]
    for t in texts:
        t, at, n = t or "", 0, 0
        while at < len(t):  # long texts in pieces, so that no list holds all words
            end = at + (1 << 20)
            m = _SPACE.search(t, end) if end < len(t) else None
            end = m.start() if m else len(t)
            w = _WORD.findall(t, at, end)
            parts.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
            n, at = n + len(w), end
        counts.append(n)
    words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return words, np.cumsum(counts), list(numbers)


def _of_slice(texts: list[str | None], least: int, times: int):
    """(number of words, runs, collapsed text) of each text."""
    words, first, vocabulary = numbered(texts)
    text, start, length, period = runs(words, first, least, times)
    n = len(words)
    keep = ~C.covered(first[text] + start + period, first[text] + start + length, n)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    look = vocabulary.__getitem__
    collapsed = []
    for lo, hi in zip(first[:-1], first[1:]):
        collapsed.append(" ".join(map(look, words[lo:hi][keep[lo:hi]].tolist())))
    listed = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
    return pa.array(np.diff(first), pa.int64()), listed, pa.array(collapsed, pa.string())


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                  min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>> by start and period,
    collapsed) of every document; collapsed keeps the first period of each run.

    min_exponent of 3 or more, min_length of 8 times as much at least."""
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs of at least three periods and two words")
    C.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            column = b.column("text")
            for lo, hi in C.slices(column, SLICE_BYTES):
                out = _of_slice(column.slice(lo, hi - lo).to_pylist(), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *out],
                                                 ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def best_run(col: str) -> Column:
    """The run of greatest exact length / period of a list as above; the first of equals."""
    better = lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a)
    return F.aggregate(col, F.get(F.col(col), F.lit(0)), better)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of which one in ten (by the checksum h of its id) becomes
    periodic: its words from a = g % n on repeat with period 1 + floor((n - a) / (3 + g % 8)),
    where g = floor(h / 10).  Others, and those without words or id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    word = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cols = C.computed(docs.select("doc_id", "text"), {
        "h": h, "words": F.when((h % 10 == 0), word).otherwise(F.array().cast("array<string>"))})
    g, n = F.floor(F.col("h") / 10), F.size("words")
    cols = C.computed(cols, {"n": n, "a": F.when(n > 0, g % n)})
    period = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))
    cols = C.computed(cols, {"p": period.cast("int"), "from": F.col("a").cast("int")})
    i = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                    lambda i: F.get(F.col("words"), F.when(i >= F.col("from"), F.col("from") + (i - F.col("from")) % F.col("p")).otherwise(i)))
    return cols.select("doc_id", F.when(F.col("n") > 0, F.array_join(i, " ")).otherwise(F.col("text")).alias("text"))
