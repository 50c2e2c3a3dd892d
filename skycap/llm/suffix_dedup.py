"""Suffix-array dedup: maximal repeats from the interval tree of an enhanced
suffix array.

A suffix array over a whole corpus does not split, so it is built piecewise:

1. Every window of ``min_bytes`` bytes has one anchor, its run of ``GRAM`` bytes
   with the least hash (leftmost on ties).  The anchor depends on the window's
   bytes only, so equal windows meet under equal anchors.  Windows whose anchor
   is found nowhere else cannot repeat and go no further (shared-hash exchange).
2. The remaining windows come in runs with a common anchor.  Each run's bytes
   are sent once per chunk to the anchor's hash range.
3. Per range, an enhanced suffix array (order by prefix doubling, common-prefix
   lengths) over these bytes is stack-scanned to its tree of common-prefix
   intervals; intervals of ``min_bytes`` or more with different left neighbours
   are maximal repeats and are given out with all their occurrences.
4. Each chunk removes what its occurrences cover.

Where a run starts, its left neighbour lies in another anchor's run; such a
suffix counts as different from all others, so no repeat is lost at a seam.

Defined results: a null text is empty; texts below ``min_bytes`` stay; equal
rows count as two places, so copies of ``min_bytes`` or more are removed whole.
Matches never cross texts.  Runs of equal bytes within one chunk are sent once;
a range's task holds the distinct runs of its anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

GRAM = 32
#: Bytes of runs whose suffixes are sorted together (more if one anchor has more).
SORT_BYTES = 1 << 18
RUNS = "bucket long, chunk long, numbers binary, lengths binary, twice binary, anchors binary, data binary"
RESULT = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary"


# ---------------------------------------------------------------------------
# Anchors
# ---------------------------------------------------------------------------
def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """Least value of every n neighbours."""
    size = 1
    while 2 * size <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (n - size)], v[n - size:]) if n > size else v


class AnchorRuns:
    """Runs of windows with a common anchor in one chunk: text-wise position of
    the first window (in the chunk's bytes), number of windows, anchor's hash."""

    def __init__(self, texts: C.Texts, min_bytes: int):
        self.base = np.concatenate([[0], np.cumsum(texts.lens)])
        at, count, key = [], [], []
        for lo, hi in texts.blocks(1 << 18):
            raw = texts.raw(lo, hi)
            n = len(raw) - min_bytes + 1
            if n <= 0:
                continue
            h = C.rolling(C._TABLE[raw], GRAM)
            tagged = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            best = (sliding_min(tagged, min_bytes - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ok = C.windows_inside(self.base[lo:hi + 1] - self.base[lo], min_bytes)
            best[~ok] = -1
            edge = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
            size = np.diff(np.append(edge, n))
            real = best[edge] >= 0
            edge, size = edge[real], size[real]
            at.append(edge + self.base[lo])
            count.append(size)
            key.append(C.mixed(h[best[edge]]))  # least hashes are small numbers: mixed again to fill all ranges
        self.at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.count = np.concatenate(count) if count else np.zeros(0, np.int64)
        self.key = C.joined(key)


def _ask(min_bytes: int, n_ranges: int):
    def step(texts: C.Texts) -> pa.Table:
        h = np.unique(AnchorRuns(texts, min_bytes).key)
        return C.payload_table([(r, texts.chunk, C.pack6(h[lo:hi])) for r, lo, hi in C.by_range(h, n_ranges)])

    return step


def _distinct_runs(texts: C.Texts, shared: np.ndarray, min_bytes: int):
    """Candidate runs, and for each the number of its distinct bytes; per
    number the first run and whether there are more."""
    runs = AnchorRuns(texts, min_bytes)
    short = runs.key >> np.uint64(16)
    s, n = np.unique(short, return_counts=True)
    pick = np.flatnonzero(C.is_in(short, shared) | C.is_in(short, s[n > 1]))
    raw = texts.raw(0, len(texts))
    at, stop = runs.at[pick], runs.at[pick] + runs.count[pick] + min_bytes - 1
    sums = np.zeros(len(pick), np.uint64)
    for lo, hi in texts.blocks(1 << 18):  # hash of the run's bytes, block by block
        a, b = np.searchsorted(at, [runs.base[lo], runs.base[hi]])
        if b > a:
            off = runs.base[lo]
            p = C.prefix_hash(C._TABLE[raw[off:runs.base[hi]]])
            sums[a:b] = (p[stop[a:b] - off] - p[at[a:b] - off]) * C.powers(int(runs.base[hi] - off) + 1)[1][at[a:b] - off]
    ident = C.mixed(sums ^ C.mixed((stop - at).astype(np.uint64)))
    _, first, number, times = np.unique(ident, return_index=True, return_inverse=True, return_counts=True)
    return runs, raw, pick, at, stop, first, number, times


def _send(min_bytes: int, n_ranges: int):
    def step(texts: C.Texts, shared: np.ndarray) -> pa.Table:
        runs, raw, pick, at, stop, first, _, times = _distinct_runs(texts, shared, min_bytes)
        key = runs.key[pick][first]
        order = np.argsort(key, kind="stable")
        cols: dict[str, list] = {n: [] for n in ("bucket", "chunk", "numbers", "lengths", "twice", "anchors", "data")}
        for r, lo, hi in C.by_range(key[order], n_ranges):
            mine = order[lo:hi]
            f = first[mine]
            cols["bucket"].append(r)
            cols["chunk"].append(texts.chunk)
            cols["numbers"].append(mine.astype(np.int64).tobytes())
            cols["lengths"].append((stop[f] - at[f]).astype(np.int64).tobytes())
            cols["twice"].append((times[mine] > 1).tobytes())
            cols["anchors"].append(key[mine].tobytes())
            cols["data"].append(b"".join(raw[a:b].tobytes() for a, b in zip(at[f], stop[f])))
        return pa.table({n: pa.array(v, pa.int64() if n in ("bucket", "chunk") else pa.binary()) for n, v in cols.items()})

    return step


# ---------------------------------------------------------------------------
# Enhanced suffix array
# ---------------------------------------------------------------------------
class SuffixArray:
    """Suffixes at ``starts`` of the given byte strings in order, with the
    common-prefix length of neighbours.  Suffixes end with their string."""

    LEVELS = (8, 16, 32, 64, 128, 256)

    def __init__(self, data: np.ndarray, stop: np.ndarray, starts: np.ndarray, least: int = 8):
        """stop: end of the string that each byte of data belongs to; common
        prefixes shorter than ``least`` may be given as 0."""
        n = len(data)
        left = stop - np.arange(n)
        word = np.zeros(n, np.uint64)
        for j in range(8):
            byte = np.zeros(n, np.uint64)
            byte[:n - j] = data[j:]
            byte[left <= j] = 0
            word |= byte << np.uint64(56 - 8 * j)
        self.left, self.word = left, word
        self.ranks = {8: self._rank(word)}
        for size in self.LEVELS[:-1]:
            r = self.ranks[size]
            self.ranks[2 * size] = self._rank((r << np.uint64(32)) | self._after(r, size))
        top = self.ranks[256]
        tail = [self._after(top, 256 * i)[starts] for i in range(int(left.max(initial=0)) // 256, 0, -1)]
        self.order = starts[np.lexsort((*tail, top[starts]))]
        a, b = self.order[:-1], self.order[1:]
        self.lcp = self._common(a, b, max(n for n in self.LEVELS if n <= max(8, least)))

    @staticmethod
    def _rank(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        s = keys[order]
        step = np.ones(len(s), np.uint64)
        step[1:] = s[1:] != s[:-1]
        out = np.empty(len(s), np.uint64)
        out[order] = np.cumsum(step, dtype=np.uint64)
        return out

    def _after(self, r: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(r), np.uint64)
        if size < len(r):
            out[:-size] = r[size:]
        out[self.left <= size] = 0
        return out

    def _common(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        most = np.minimum(self.left[a], self.left[b])
        got = np.zeros(len(a), np.int64)
        live = np.flatnonzero(self.ranks[level][a] == self.ranks[level][b])
        x, y, cap, l = a[live], b[live], most[live], np.zeros(len(live), np.int64)
        for size in [256] * max(1, int(cap.max(initial=0)) // 256) + [128, 64, 32, 16, 8]:
            r = self.ranks[size]
            can = l + size <= cap
            i, j = np.where(can, x + l, x), np.where(can, y + l, y)
            l += np.where(can & (r[i] == r[j]), size, 0)
        rest = l < cap
        i, j = np.where(rest, x + l, x), np.where(rest, y + l, y)
        diff = self.word[i] ^ self.word[j]
        for byte in range(7):
            l += rest & (l < cap) & ((diff >> np.uint64(56 - 8 * byte)) == 0)
        got[live] = np.minimum(l, cap)
        return got


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int):
    """Stack scan of the common-prefix intervals of neighbouring suffixes.

    lcp: common prefixes of neighbours; left: code of the byte before each
    suffix, codes below 0 differ from all others.  Yields (length, first, last)
    of every interval of ``least`` or more whose left neighbours differ."""
    stack: list[list] = []  # length, first, left code or None where they differ

    def merge(x, y):
        return x if x == y and x is not None and x >= 0 else None

    codes = left.tolist()
    lengths = lcp.tolist() + [0]
    for i, l in enumerate(lengths):
        first, code = i, codes[i] if codes[i] >= 0 else None
        while stack and stack[-1][0] > l:
            length, first, top = stack.pop()
            top = merge(top, code)
            if top is None:
                yield length, first, i
            code = top
        if stack and stack[-1][0] == l:
            stack[-1][2] = merge(stack[-1][2], code)
        elif l >= least:
            stack.append([l, first, code])


def _repeats(data: np.ndarray, lengths: np.ndarray, min_bytes: int):
    """(string, from, to) of what repeats between or within the given distinct strings."""
    stop = np.cumsum(lengths)
    begin = stop - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inner = np.arange(len(data)) - begin[owner]
    starts = np.flatnonzero(stop[owner] - np.arange(len(data)) >= min_bytes)
    sa = SuffixArray(data, stop[owner], starts, min_bytes)
    code = np.full(len(data), -1, np.int64)
    code[1:] = data[:-1]
    code[begin] = -1
    lcp = np.where(sa.lcp >= min_bytes, sa.lcp, 0)
    code = code[sa.order]
    # neighbours of min_bytes or more; groups with one left byte only are part of longer ones
    head = np.flatnonzero(np.concatenate([[True], lcp == 0]))
    size = np.diff(np.append(head, len(code)))
    low, high = (np.minimum.reduceat(code, head), np.maximum.reduceat(code, head)) if len(head) else (head, head)
    worth = (size > 1) & ((low < 0) | (low != high))
    s, f, t = [], [], []
    for h, n in zip(head[worth], size[worth]):
        best = np.zeros(n, np.int64)
        for length, first, last in maximal_repeats(lcp[h:h + n - 1], code[h:h + n], min_bytes):
            np.maximum(best[first:last + 1], length, out=best[first:last + 1])
        hit = best > 0
        at = sa.order[h:h + n][hit]
        s.append(owner[at])
        f.append(inner[at])
        t.append(inner[at] + best[hit])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (s, f, t))


def _scan(min_bytes: int):
    def answer(table: pa.Table) -> pa.Table:
        ints = lambda name: [np.frombuffer(b, np.int64) for b in table.column(name).to_pylist()]
        chunk = table.column("chunk").to_numpy()
        numbers, lengths = ints("numbers"), ints("lengths")
        holder = np.repeat(chunk, [len(x) for x in numbers])
        number, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, lengths))
        anchor = C.joined([np.frombuffer(b, np.uint64) for b in table.column("anchors").to_pylist()])
        twice = np.concatenate([np.frombuffer(b, bool) for b in table.column("twice").to_pylist()])
        blob = b"".join(table.column("data").to_pylist())
        offset = np.cumsum(length) - length
        view = memoryview(blob)
        # equal runs of several chunks stand once, with all their holders
        index: dict[bytes, int] = {}
        which = np.empty(len(number), np.int64)
        for i, (o, n) in enumerate(zip(offset.tolist(), length.tolist())):
            which[i] = index.setdefault(bytes(view[o:o + n]), len(index))
        n_runs = len(index)
        rep = np.full(n_runs, -1, np.int64)
        rep[which[::-1]] = np.arange(len(which))[::-1]
        copies = np.bincount(which, weights=1 + twice, minlength=n_runs) > 1
        order = np.argsort(anchor[rep], kind="stable")
        key, size = anchor[rep][order], length[rep][order]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.add.reduceat(size, cut) if len(cut) else np.zeros(0, np.int64)
        strings = [np.flatnonzero(copies)]
        begins, ends = [np.zeros(len(strings[0]), np.int64)], [length[rep][strings[0]]]
        data = np.frombuffer(blob, np.uint8)
        bounds = np.append(cut, len(order))
        i = 0
        while i < len(cut):
            j, total = i, 0
            while j < len(cut) and (j == i or total + group[j] <= SORT_BYTES):
                total += group[j]
                j += 1
            mine = order[bounds[i]:bounds[j]]
            i = j
            # an anchor with one distinct run has nothing to be compared with but itself
            src = rep[mine]
            part = np.concatenate([data[offset[k]:offset[k] + length[k]] for k in src])
            s, f, t = _repeats(part, length[src], min_bytes)
            strings.append(mine[s])
            begins.append(f)
            ends.append(t)
        s, f, t = np.concatenate(strings), np.concatenate(begins), np.concatenate(ends)
        by = np.argsort(s, kind="stable")
        s, f, t = s[by], f[by], t[by]
        lo, hi = np.searchsorted(s, which), np.searchsorted(s, which, side="right")
        times = hi - lo
        pos = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        code = (np.repeat(number, times) << 32) | (f[pos] << 16) | t[pos]
        back = np.repeat(holder, times)
        out = [(int(c), code[back == c].astype(np.uint64).tobytes()) for c in np.unique(back)]
        return C.answer_table([c for c, _ in out], [p for _, p in out])

    return answer


def _settle(min_bytes: int):
    def step(texts: C.Texts, shared: np.ndarray, found: np.ndarray) -> pa.Table:
        runs, raw, _, at, _, first, number, _ = _distinct_runs(texts, shared, min_bytes)
        found = np.sort(found).astype(np.int64)
        owner, f, t = found >> 32, (found >> 16) & 0xFFFF, found & 0xFFFF
        by = np.argsort(number, kind="stable")  # all places of each distinct run
        lo = np.searchsorted(number[by], owner)
        times = np.searchsorted(number[by], owner, side="right") - lo
        pos = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        place = at[by[pos]]
        starts, stops = place + np.repeat(f, times), place + np.repeat(t, times)
        whole = np.flatnonzero(texts.copies & (texts.lens >= min_bytes))
        starts = np.concatenate([starts, runs.base[whole]])
        stops = np.concatenate([stops, runs.base[whole + 1]])
        gone = C.covered(starts, stops, len(raw))
        upto = np.concatenate([[0], np.cumsum(gone)])
        removed = upto[runs.base[1:]] - upto[runs.base[:-1]]
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        edge = runs.base[:-1][texts.lens > 0]
        rise[edge] = gone[edge]
        upto = np.concatenate([[0], np.cumsum(rise)])
        spans = upto[runs.base[1:]] - upto[runs.base[:-1]]
        kept = [raw[a:b].tobytes() if not r else raw[a:b][~gone[a:b]].tobytes()
                for a, b, r in zip(runs.base[:-1], runs.base[1:], removed)]
        return pa.table({"k1": texts.k1, "k2": texts.k2, "n_bytes": texts.lens.astype(np.int64), "n_removed": removed.astype(np.int64),
                         "n_spans": spans.astype(np.int64), "kept": pa.array(kept, pa.binary())})

    return step


def suffix_dedup(docs: DataFrame, text: str = "text", min_bytes: int = 400) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept) per distinct text: every byte
    covered by a string of ``min_bytes`` bytes that also starts elsewhere goes;
    ``kept`` holds the bytes left.  ``common.attach`` gives them to documents."""
    if not 2 * GRAM <= min_bytes <= 16384:
        raise ValueError("min_bytes must lie between 64 and 16384")
    C.prepare(docs.sparkSession)
    n_bytes = C.text_bytes(docs, text)
    chunks = C.chunked(docs, text, C.chunk_count(n_bytes))
    anchors = C.per_chunk(chunks, _ask(min_bytes, C.range_count(n_bytes // 32)), C.PAYLOAD)
    shared = C.exchange(anchors, C.shared_answers(6))
    runs = C.with_answers(chunks, shared, _send(min_bytes, C.chunk_count(n_bytes)), RUNS)
    found = C.exchange(runs, _scan(min_bytes))
    both = shared.select("chunk", F.lit(0).alias("tag"), "payload").unionByName(
        found.select("chunk", F.lit(1).alias("tag"), "payload"))
    return C.with_tagged(chunks, both, _settle(min_bytes), RESULT)
