"""Helpers shared by the corpus operators.

*Chunks.*  Texts are keyed by two 64-bit hashes and dealt into chunks of about
``CHUNK_BYTES`` by that key, so equal texts meet in one chunk however many
rows hold them (each scan task sends a text at most twice) and no source,
language or id decides where a row goes.

*Shared-hash exchange.*  "Which of my hashes occur in another chunk?" is asked
by sending, per chunk and hash range, one packed sorted array; the range's
task answers with one packed array per chunk.  A hash that every document
holds is sent once per chunk, so hot keys never pile up, and no pairs exist.
"""

from __future__ import annotations

import ctypes
import gc
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.session import ensure_checkpoint_dir, scratch_path, ship_package

CHUNK_BYTES = 4 << 20
MIN_CHUNKS = 64
#: Values that one task of a hash range sorts at once (about 100 MB of arrays).
RANGE_VALUES = 1 << 20

#: Text that a map over rows copies at once.
PIECE_BYTES = 1 << 20

SPACES = b" \t\n\x0b\x0c\r"
_MASK = (1 << 64) - 1


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder from the session, package on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (lineage cut that
    survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed(df: DataFrame, cols: dict) -> DataFrame:
    """df with columns that are evaluated once: they pass a generator of one row
    each, below which no later filter on them is pushed and evaluated again."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


# ---------------------------------------------------------------------------
# Texts and chunks
# ---------------------------------------------------------------------------
def keyed_text(text: str):
    """Columns k1, k2 (128-bit key of the text, null counts as empty) and text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), t.alias("text")


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def chunk_count(n_bytes: int) -> int:
    return max(MIN_CHUNKS, math.ceil(n_bytes / CHUNK_BYTES))


def _first_of_each(batches):
    """Each text once per task; a second equal text as a row without text, later ones not at all.

    Rows are copied some at a time, and only where one goes."""
    drop_slot()
    seen: dict[tuple[int, int], int] = {}
    for b in batches:
        for lo, hi in slices(b.column("text"), PIECE_BYTES):
            part = b.slice(lo, hi - lo)
            keep, blank = [], []
            for i, k in enumerate(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist())):
                n = seen.get(k, 0)
                if n < 2:
                    seen[k] = n + 1
                    keep.append(i)
                    blank.append(n == 1)
            if not keep:
                continue
            if len(keep) < hi - lo or any(blank):
                part = part.take(pa.array(keep))
            text = part.column("text")
            if any(blank):
                text = pa.compute.if_else(pa.array(blank), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("k1"), part.column("k2"), text],
                                             ["chunk", "k1", "k2", "text"])
    give_back()


def chunked(docs: DataFrame, text: str, n_chunks: int) -> DataFrame:
    """(chunk, k1, k2, text): the distinct texts of each task, dealt by key."""
    k1, k2, t = keyed_text(text)
    rows = docs.select(k1, k2, t).select(F.pmod("k1", F.lit(n_chunks)).alias("chunk"), "k1", "k2", "text")
    return rows.mapInArrow(_first_of_each, "chunk long, k1 long, k2 long, text string")


class Texts:
    """The distinct texts of one chunk in key order; ``copies`` says that a
    second row of the corpus holds the same text."""

    def __init__(self, table: pa.Table):
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        text = table.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
        has = np.asarray(text.is_valid())
        order = np.lexsort((~has, k2, k1))
        k1, k2 = k1[order], k2[order]
        new = np.ones(len(order), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        first = np.flatnonzero(new)
        self.k1, self.k2 = k1[first], k2[first]
        self.copies = np.diff(np.append(first, len(order))) > 1
        self.text = text.take(pa.array(order[first])).cast(pa.large_binary())
        self.chunk = int(table.column("chunk")[0].as_py()) if table.num_rows else -1
        self.lens = np.diff(np.frombuffer(self.text.buffers()[1], np.int64, len(first) + 1, self.text.offset * 8))

    def __len__(self):
        return len(self.k1)

    def raw(self, lo: int, hi: int) -> np.ndarray:
        """Bytes of the texts lo..hi-1, one after the other."""
        if hi <= lo or self.text.buffers()[2] is None:
            return np.zeros(0, np.uint8)
        off = np.frombuffer(self.text.buffers()[1], np.int64, len(self) + 1, self.text.offset * 8)
        return np.frombuffer(self.text.buffers()[2], np.uint8, int(off[hi] - off[lo]), int(off[lo]))

    def blocks(self, n_bytes: int = 1 << 18):
        """Ranges of texts of about n_bytes each (one long text may be more)."""
        lo, size = 0, 0
        for i, n in enumerate(self.lens):
            size += int(n)
            if size >= n_bytes:
                yield lo, i + 1
                lo, size = i + 1, 0
        if lo < len(self):
            yield lo, len(self)


def slices(column: pa.Array, n_bytes: int):
    """Ranges of an Arrow column of about n_bytes of text each (one long text may be more)."""
    lo, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).fill_null(0).to_pylist()):
        size += n
        if size >= n_bytes:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(column):
        yield lo, len(column)


_SLOT: list = [None, None]


def worker_slot(key, make):
    """The Python worker's one large cached object, kept between tasks.  Another
    operator's object takes the place of the last, so that a worker that serves
    several stages holds the cache of one."""
    if _SLOT[0] is None or _SLOT[0] is not key and _SLOT[0] != key:
        _SLOT[:] = None, None
        gc.collect()
        _SLOT[:] = key, make()
    return _SLOT[1]


def drop_slot() -> None:
    """Drop a cache left by another stage."""
    if _SLOT[0] is not None:
        _SLOT[:] = None, None
        gc.collect()


def give_back() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(fn):
    """A group's function that drops a cache left by another stage first and
    gives freed memory back to the system after it."""

    def run(*tables):
        drop_slot()
        out = fn(*tables)
        del tables
        give_back()
        return out

    return run


# ---------------------------------------------------------------------------
# Hashing
# ---------------------------------------------------------------------------
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        if size > 1 << 21:  # a very long text: not kept
            return np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j over j < i."""
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][:len(values)], out=p[1:])
    return p


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values (len - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix_hash(values)
    return mixed((p[k:] - p[:-k]) * powers(len(values) + 1)[1][:n])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: Texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the chunk, index of each text's first word plus the total)."""
    parts, counts = [], []
    for lo, hi in texts.blocks():
        raw = texts.raw(lo, hi)
        lens = texts.lens[lo:hi]
        # one space after each text keeps words of neighbours apart
        ends = np.cumsum(lens + 1)
        buf = np.full(int(ends[-1]), 32, np.uint8)
        inside = np.ones(len(buf), bool)
        inside[ends - 1] = False
        buf[inside] = raw
        if lower:
            buf = _LOWER[buf]
        space = _IS_SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        starts, stops = edge[0::2], edge[1::2]
        p = prefix_hash(_TABLE[buf])
        parts.append(mixed((p[stops] - p[starts]) * powers(len(buf) + 1)[1][starts]))
        counts.append(np.diff(np.searchsorted(starts, np.concatenate([[0], ends]))))
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return words, first.astype(np.int64)


def windows_inside(first: np.ndarray, k: int) -> np.ndarray:
    """For each start of a run of k items: whether it ends within its text."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    ok = np.zeros(total + 1, np.int32)
    lens = np.diff(first)
    fit = lens >= k
    ok[first[:-1][fit]] += 1
    np.subtract.at(ok, first[:-1][fit] + lens[fit] - k + 1, 1)
    return np.cumsum(ok[:n]).astype(bool) if n else np.zeros(0, bool)


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n positions that lie in some [start, stop)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.subtract.at(d, stops, 1)
    return np.cumsum(d[:n]) > 0


# ---------------------------------------------------------------------------
# Packed arrays and the shared-hash exchange
# ---------------------------------------------------------------------------
def pack6(h: np.ndarray) -> bytes:
    """Upper 48 bits of each hash, six bytes a value."""
    return np.ascontiguousarray(h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack6(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def pack8(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).tobytes()


def unpack8(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def ranges_of(h: np.ndarray, n_ranges: int) -> np.ndarray:
    """Range number of each hash; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)


def by_range(h: np.ndarray, n_ranges: int):
    """(range, lo, hi) slices of the sorted array h."""
    r = ranges_of(h, n_ranges)
    cuts = np.flatnonzero(np.diff(r)) + 1
    cuts = np.concatenate([[0], cuts, [len(h)]])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield int(r[lo]), int(lo), int(hi)


def range_count(n_values: int) -> int:
    return max(16, math.ceil(n_values / RANGE_VALUES))


PAYLOAD = "bucket long, chunk long, payload binary"
ANSWER = "chunk long, payload binary"


def payload_table(rows: list[tuple]) -> pa.Table:
    """Rows of (bucket, chunk, bytes)."""
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "chunk": pa.array(cols[1], pa.int64()),
                     "payload": pa.array(cols[2], pa.binary())})


def answer_table(chunks, payloads) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "payload": pa.array(payloads, pa.binary())})


def payloads(table: pa.Table, name: str = "payload") -> list[bytes]:
    return table.column(name).to_pylist()


def joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)


def shared_answers(width: int, counts: bool = False):
    """Per hash range: tell each chunk which of its hashes another chunk also
    sent.  With ``counts``, an answer is (upper 48 bits << 16) | chunks."""
    unpack = unpack6 if width == 6 else unpack8

    def answer(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        parts = [unpack(b) for b in payloads(table)]
        values = joined(parts)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        order = np.argsort(values, kind="stable")
        s = values[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(s)))
        times = np.repeat(size, size)
        hit = times > 1
        back = owner[order][hit]
        got = s[hit]
        if counts:
            got = (got << np.uint64(16)) | np.minimum(times[hit], 65535).astype(np.uint64)
        put = np.argsort(back, kind="stable")
        cut = np.searchsorted(back[put], np.arange(len(parts) + 1))
        got = got[put]
        out = [(int(c), pack8(got[cut[i]:cut[i + 1]])) for i, c in enumerate(chunk) if cut[i + 1] > cut[i]]
        return answer_table([c for c, _ in out], [p for _, p in out])

    return answer


def is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def exchange(asked: DataFrame, answer) -> DataFrame:
    run = lean(answer)
    return asked.groupBy("bucket").applyInArrow(lambda table: run(table), ANSWER)


def with_answers(chunks: DataFrame, answers: DataFrame, step, schema: str) -> DataFrame:
    """``step(texts, sorted answers)`` for every chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = joined([unpack8(b) for b in payloads(right)])
        return step(Texts(left), np.sort(got))

    slim = lean(run)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda left, right: slim(left, right), schema)


def with_tagged(chunks: DataFrame, answers: DataFrame, step, schema: str) -> DataFrame:
    """``step(texts, answers with tag 0, answers with tag 1)``, both sorted."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tag = right.column("tag").to_pylist()
        got = [unpack8(b) for b in payloads(right)]
        one, two = (np.sort(joined([g for g, t in zip(got, tag) if t == k])) for k in (0, 1))
        return step(Texts(left), one, two)

    slim = lean(run)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda left, right: slim(left, right), schema)


def per_chunk(chunks: DataFrame, step, schema: str) -> DataFrame:
    run = lean(lambda table: step(Texts(table)))
    return chunks.groupBy("chunk").applyInArrow(lambda table: run(table), schema)


def attach(docs: DataFrame, doc_id: str, text: str, results: DataFrame) -> DataFrame:
    """One row per document: its id as doc_id and the columns of its text's result."""
    k1, k2, _ = keyed_text(text)
    ids = docs.select(F.col(doc_id).alias("doc_id"), k1, k2)
    return ids.join(results, ["k1", "k2"]).drop("k1", "k2")
