"""Sequence packing with bounded space.

Each partition keeps ``open_windows`` windows of ``size`` tokens.  A document is its
token ids and an end id; whole windows are cut off a document longer than one,
and the rest goes to the open window that it fills best.  Where it fits none,
the fullest window is emitted and a new one opened.  What is open at the end of
the partitions are merged with each other in a second step, by groups of
partitions, so that no task or driver sees them all.

Ids come from the tokenizers library, in a bounded cache of words per Python
worker.  Results are written to the shared folder once, so a lost executor
repeats its own partition only, with the same sequence numbers (partition number
and count).

Defined results: a null text is empty; its document is the end id alone, so
every document has at least one piece.  Equal rows are packed one by one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C
from skycap.llm.bpe import Numbers, gathered

SIZE = 4096
OPEN_WINDOWS = 64
END_ID = 2
#: Partitions whose open windows are merged together.
MERGE_PARTITIONS = 256

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words that a worker keeps (about 80 MB).
CACHE_WORDS = 400_000
WORDS_A_CALL = 512


class WordIds:
    """Ids of texts by a tokenizer that drops white space, each word encoded once."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words by one call, and each word's number; offsets tell which word an id belongs to."""
        got = self.tok.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        at = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(ids))
        begin = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        return ids, np.bincount(np.searchsorted(begin, at, side="right") - 1, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        got = [self._ids(words[i:i + WORDS_A_CALL]) for i in range(0, len(words), WORDS_A_CALL)]
        n = np.concatenate([c for _, c in got])
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.count = np.concatenate([self.count, n])
        self.flat = np.concatenate([self.flat, *(i for i, _ in got)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids)."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        which: list[int] = []
        ends = []
        look = self.known.__getitem__
        for t in texts:
            which += map(look, t.replace("\n", " ").split(" "))
            ends.append(len(which))
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            self._learn(fresh)
        w = np.array(which, np.int64)
        ids, n = gathered(self.flat, self.begin[w], self.count[w])
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(np.concatenate([[0], upto[np.array(ends, np.int64)]]))


class OpenWindows:
    """A bounded set of windows with room; items go to the one they fill best."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.rooms: list[tuple[int, int]] = []  # (room left, id), ascending

    def place(self, length: int) -> tuple[int, int]:
        """(sequence id, offset) of an item."""
        if length == self.size:
            self.next_id += 1
            return self.next_id - 1, 0
        at = bisect_left(self.rooms, (length, -1))
        if at == len(self.rooms):  # fits none
            if len(self.rooms) >= self.most:
                self.rooms.pop(0)  # the fullest is emitted
            room, seq = self.size, self.next_id
            self.next_id += 1
        else:
            room, seq = self.rooms.pop(at)
        if room > length:
            insort(self.rooms, (room - length, seq))
        return seq, self.size - room


def _pack(spec, size: int, most: int, end_id: int):
    def run(batches):
        words = C.worker_slot(("words", spec.value), lambda: WordIds(spec.value))
        windows = OpenWindows(size, most, TaskContext.get().partitionId() << 32)
        for b in batches:
            keys, column = b.column("doc_id"), b.column("text")
            for lo, hi in C.slices(column, C.PIECE_BYTES):  # only a slice's texts are copied
                ids, counts = words.encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
                at = np.cumsum(counts)
                ids = np.insert(ids, at, end_id).astype("<u4")
                counts = counts + 1
                raw, stop = memoryview(ids).cast("B"), np.cumsum(counts)
                doc, cols = [], []
                for i, (n, s) in enumerate(zip(counts.tolist(), (stop - counts).tolist())):
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        seq, offset = windows.place(length)
                        doc.append(lo + i)
                        cols.append((start, length, zlib.crc32(raw[4 * (s + start):4 * (s + start + length)]), n, seq, offset))
                table = np.array(cols, np.int64)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), *(pa.array(c) for c in table.T)],
                                                 ["doc_id", *(c.split()[0] for c in PIECES.split(", "))])
        # the windows that are still open, at most ``most``: rows of start -1 with what they hold
        if windows.rooms:
            room, seq = np.array(windows.rooms, np.int64).T
            zero = np.zeros(len(seq), np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(seq), keys.type), *map(pa.array, (zero - 1, size - room, zero, zero, seq, zero))],
                                             ["doc_id", *(c.split()[0] for c in PIECES.split(", "))])
        C.give_back()

    return run


def _merge(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit, largest first, over the windows that are not full."""
        pdf = pdf.sort_values(["total", "sequence_id"], ascending=[False, True])
        windows = OpenWindows(size, len(pdf) + 1, 0)
        placed = [windows.place(int(n)) for n in pdf["total"]]
        first: dict[int, int] = {}
        new = [first.setdefault(s, q) for (s, _), q in zip(placed, pdf["sequence_id"].tolist())]
        return pd.DataFrame({"sequence_id": pdf["sequence_id"], "merged_id": new, "shift": [o for _, o in placed]})

    return run


def pack_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                   open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  A sequence's pieces follow each other from offset 0."""
    spark = docs.sparkSession
    C.prepare(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = C.written(rows.mapInArrow(_pack(spec, size, open_windows, end_id), f"doc_id {kind}, {PIECES}"), "packed")
    # only windows open at a partition's end: a bounded number from each of a bounded number of partitions
    left = pieces.where("start < 0").select("sequence_id", F.col("length").alias("total"))
    moved = left.withColumn("part", F.floor(F.shiftright("sequence_id", 32) / MERGE_PARTITIONS)).groupBy("part").applyInPandas(
        _merge(size), "sequence_id long, merged_id long, shift long")
    return pieces.where("start >= 0").join(moved, "sequence_id", "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("merged_id", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
