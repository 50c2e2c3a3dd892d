"""Substring dedup by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``block`` words, so
each window of ``window >= 2 * block - 1`` words holds a whole block.  The
blocks are indexed by hash range; every rolling run of ``block`` words of every
text probes that index.  A run that some other place holds as a block is an
anchor hit, and hits are extended: each window of ``window`` words around a hit
is compared with the windows that the other chunks found around their hits,
and touching repeated windows join to maximal exact repeats.

Work and memory: a chunk sends each distinct run once (six bytes), so a passage
that a third of all documents share costs one entry per chunk and pairs are
never formed.  Runs are told apart by 48 bits for the probe, which only picks
candidates, and windows by 64 bits.

Defined results: a null or empty text has no words, nothing removed and an
empty rest; equal rows count as two places and are removed whole where they
have a window; texts below ``window`` words stay.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

RESULT = "k1 long, k2 long, n_words long, n_removed long, kept string"


def _runs(texts: C.Texts, block: int):
    words, first = C.word_hashes(texts)
    runs = C.rolling(words, block)
    inside = C.windows_inside(first, block)
    return words, first, runs, inside


def _ask(block: int, n_ranges: int):
    """Blocks (payload) and probes (second row of the same range)."""

    def step(texts: C.Texts) -> pa.Table:
        _, first, runs, inside = _runs(texts, block)
        rows = []
        at = np.arange(len(runs)) - np.repeat(first[:-1], np.diff(first))[:len(runs)]
        for kind, pick in ((0, inside & (at % block == 0)), (1, inside)):
            h = np.unique(runs[pick])
            rows += [(r, texts.chunk * 2 + kind, C.pack6(h[lo:hi])) for r, lo, hi in C.by_range(h, n_ranges)]
        return C.payload_table(rows)

    return step


def _probe(table: pa.Table) -> pa.Table:
    """Per range: index the blocks, look up each chunk's probes, answer those
    that another chunk holds as a block."""
    code = table.column("chunk").to_numpy()
    data = [C.unpack6(b) for b in C.payloads(table)]
    blocks = [(c >> 1, d) for c, d in zip(code, data) if not c & 1]
    if not blocks:
        return C.answer_table([], [])
    values = C.joined([d for _, d in blocks])
    owner = np.repeat(np.array([c for c, _ in blocks], np.int64), [len(d) for _, d in blocks])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    index, low, high = values[start], np.minimum.reduceat(owner, start), np.maximum.reduceat(owner, start)
    chunks, out = [], []
    for c, d in zip(code, data):
        if c & 1:
            at = np.searchsorted(index, d)
            at[at == len(index)] = 0
            hit = (index[at] == d) & ((low[at] != c >> 1) | (high[at] != c >> 1))
            if hit.any():
                chunks.append(int(c >> 1))
                out.append(C.pack8(d[hit]))
    return C.answer_table(chunks, out)


def _candidates(texts: C.Texts, hits: np.ndarray, window: int, block: int):
    """Windows around a hit: their start, hash; and the texts' first words."""
    words, first, runs, inside = _runs(texts, block)
    short = runs >> np.uint64(16)
    s, n = np.unique(short[inside], return_counts=True)
    anchor = inside & (C.is_in(short, hits) | C.is_in(short, s[n > 1]))
    upto = np.concatenate([[0], np.cumsum(anchor)])
    wins = C.rolling(words, window)
    ok = C.windows_inside(first, window)
    at = np.arange(len(wins))
    pick = ok & (upto[at + window - block + 1] > upto[at])
    return first, at[pick], wins[pick], ok


def _extend(window: int, block: int, n_ranges: int):
    def step(texts: C.Texts, hits: np.ndarray) -> pa.Table:
        _, _, wins, _ = _candidates(texts, hits, window, block)
        h = np.unique(wins)
        return C.payload_table([(r, texts.chunk, C.pack8(h[lo:hi])) for r, lo, hi in C.by_range(h, n_ranges)])

    return step


def _settle(window: int, block: int, keep_layout: bool):
    def step(texts: C.Texts, left: np.ndarray, shared: np.ndarray) -> pa.Table:
        first, at, wins, ok = _candidates(texts, left, window, block)
        s, n = np.unique(wins, return_counts=True)
        again = C.is_in(wins, shared) | C.is_in(wins, s[n > 1])
        total = int(first[-1])
        twin = np.repeat(texts.copies, np.diff(first))
        starts = np.concatenate([at[again], np.flatnonzero(ok & twin[:len(ok)])])
        gone = C.covered(starts, starts + window, total)
        removed = np.add.reduceat(np.append(gone, False), first[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        removed[np.diff(first) == 0] = 0
        kept = []
        for i, (text, r) in enumerate(zip(texts.text.to_pylist(), removed)):
            if keep_layout and not r:
                kept.append(text)
                continue
            words = text.split()
            if r:
                words = itertools.compress(words, ~gone[first[i]:first[i + 1]])
            kept.append(b" ".join(words))
        return pa.table({"k1": texts.k1, "k2": texts.k2, "n_words": np.diff(first), "n_removed": removed,
                         "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return step


def substring_dedup(docs: DataFrame, text: str = "text", window: int = 35, block: int | None = None,
                    keep_layout: bool = False) -> DataFrame:
    """(k1, k2, n_words, n_removed, kept) per distinct text; ``attach`` gives
    them to the documents.  ``kept`` is the words left, joined by one space;
    with ``keep_layout`` a text that loses nothing stays as it is."""
    C.prepare(docs.sparkSession)
    block = block or (window + 1) // 2
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    n_bytes = C.text_bytes(docs, text)
    n_ranges = C.range_count(n_bytes // 4)
    chunks = C.chunked(docs, text, C.chunk_count(n_bytes))
    asked = C.per_chunk(chunks, _ask(block, n_ranges), C.PAYLOAD)
    hits = C.exchange(asked, _probe)
    around = C.with_answers(chunks, hits, _extend(window, block, n_ranges), C.PAYLOAD)
    repeated = C.exchange(around, C.shared_answers(8))
    both = hits.select("chunk", F.lit(0).alias("tag"), "payload").unionByName(
        repeated.select("chunk", F.lit(1).alias("tag"), "payload"))
    return C.with_tagged(chunks, both, _settle(window, block, keep_layout), RESULT)
