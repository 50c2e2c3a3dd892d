"""Vector code compression: product codes trained by member-resident Lloyd rounds.

Components become integers (floor of ``SCALE`` times the value), vectors are cut into
equal parts, and each part position has a codebook of its own.  The parts themselves,
the *members*, live in partitions by (position, entry, salt): the owners of an entry.

* Owners update: sums and counts of an entry come from its resident members; a task
  sends one partial sum an entry, never members.
* Residents are assigned again where they are, against the broadcast codebooks, and
  written there.  Only members whose entry changes are shuffled, to the owners of
  their new entry.

An entry that holds a third of all members is dealt to ``salts`` owners, a number that
grows with the rows, so no owner's share does.  Each round reads tables written by the
one before (no lineage beyond a round).  To the driver go the codebooks alone (positions
x entries x width integers, fixed by parameters), never members.

All arithmetic is on integers, so results do not depend on order or partitions.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped; repeated rows are members each of their own; a null id sorts after all others
and gives a row as any; vectors shorter than the longest, or whose length is no multiple
of the parts, are filled up with zeros; fewer rows than entries give a codebook of
fewer entries; components are held within +-2^26 before scaling's result overflows a
long distance (so a component beyond +-262,144 counts as that); a table without usable
rows gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Greatest scaled component; squared distances of vectors stay exact.
BOUND = 1 << 26
#: Members that one owner holds in the mean where an entry has all members of a position.
OWNER_MEMBERS = 1 << 15
#: Distances held at once.
CELLS = 1 << 22

MEMBER = ["row", "position", "entry", "salt", "part", "vec_id", "label"]


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite, F.lit(False))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower of equals; squared distance) of each part."""
    entry, dist = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
    step = max(1, CELLS // max(1, book.size))
    for lo in range(0, len(parts), step):
        p = parts[lo:lo + step].astype(np.int64)
        d = np.zeros((len(p), len(book)), np.int64)
        for j in range(book.shape[1]):
            d += (p[:, j, None] - book[None, :, j]) ** 2
        best = d.argmin(1)
        entry[lo:lo + step], dist[lo:lo + step] = best, d[np.arange(len(p)), best]
    return entry, dist


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one array, filled up with zeros."""
    ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width and (np.diff(ends) == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), flat.dtype)
    size = np.diff(ends).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - ends[:-1].astype(np.int64)[row]] = flat
    return out


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -BOUND, BOUND).astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32).ravel()))


class Codes:
    """The result: ``codes`` (row, vec_id, label, code, error) and ``books`` (position, entry, component)."""

    def __init__(self, codes: DataFrame, books: np.ndarray):
        self.codes, self.books = codes, books

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _dealt(members: DataFrame, n: int) -> DataFrame:
    return members.repartition(n, "position", "entry", "salt")


def _updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry the floor of its members' mean, summed where they reside."""
    width = books.shape[2]
    sums = members.groupBy("position", "entry").agg(
        F.count("*").alias("n"), *[F.sum(F.col("part")[j].cast("long")).alias(f"s{j}") for j in range(width)])
    new = books.copy()
    for r in sums.collect():  # positions x entries rows at most
        new[r.position, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return new


def _reassigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members with their nearest entry, the entry they came with, and the distance; no shuffle."""
    sent = members.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        width = sent.value.shape[2]
        for b in batches:
            position = b.column("position").to_numpy()
            part = matrix(b.column("part"), width)
            entry, dist = np.empty(len(part), np.int32), np.empty(len(part), np.int64)
            for k in np.unique(position):
                at = np.flatnonzero(position == k)
                entry[at], dist[at] = nearest(part[at], sent.value[k])
            new = {"entry": pa.array(entry), "was": b.column("entry"), "dist": pa.array(dist)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in [*MEMBER, "was", "dist"]],
                                             [*MEMBER, "was", "dist"])

    return members.mapInArrow(run, _schema(members) + ", was int, dist long")


def _schema(df: DataFrame) -> str:
    """Columns of members, with the types that ids and labels have in df."""
    kind = {c: df.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return f"row long, position int, entry int, salt int, part array<int>, vec_id {kind['vec_id']}, label {kind['label']}"


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all usable vectors and the codebooks that they index."""
    if not (0 < entries <= 256 and parts > 0 and rounds >= 0):
        raise ValueError("1 to 256 entries, some parts, no fewer than 0 rounds")
    spark = vectors.sparkSession
    C.prepare(spark)
    rows = vectors.where(usable(vector)).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("v"))
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, -(-(longest or 0) // parts))
    salts = max(1, -(-n // OWNER_MEMBERS))
    n_owners = parts * max(4, salts)

    # the first codebooks: a top-k of as many rows as a codebook has entries
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((len(seeds), parts * width), np.int64)
    for i, r in enumerate(seeds):
        books[i, :len(r.v)] = scaled(np.array(r.v))
    books = np.ascontiguousarray(books.reshape(len(seeds), parts, width).transpose(1, 0, 2))

    if not n:
        empty = rows.select("row", "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
        return Codes(empty, books)
    sent = spark.sparkContext.broadcast(books)

    def split(batches):
        """A row for each part of each vector; id and label go with the first part."""
        turn = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                m = b.num_rows
                v = scaled(matrix(b.column("v"), parts * width)).reshape(m, parts, width)
                salt = pa.array(((turn + np.arange(m)) % salts).astype(np.int32))
                turn += m
                named = [b.column("vec_id"), b.column("label")]
                blank = [pa.nulls(m, c.type) for c in named]
                for k in range(parts):
                    part = np.ascontiguousarray(v[:, k])
                    entry, _ = nearest(part, sent.value[k])
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(m, k, np.int32)), pa.array(entry), salt,
                                                      _lists(part), *(blank if k else named)], MEMBER)

    members = C.written(_dealt(rows.mapInArrow(split, _schema(rows)), n_owners), "codes-members")
    for k in range(rounds):
        books = _updated(members, books)
        if k == rounds - 1:
            break
        again = C.written(_reassigned(members, books), f"codes-round{k}")
        moved = C.written(_dealt(again.where("entry <> was").select(MEMBER), n_owners), f"codes-moved{k}")
        members = again.where("entry = was").select(MEMBER).unionByName(moved)

    # a byte of the code for each position, eight positions a long
    byte = F.call_function("shiftleft", F.col("entry").cast("long"), (8 * (7 - F.col("position") % 8)).cast("int"))
    words = [f"w{w}" for w in range(-(-parts // 8))]
    whole = _reassigned(members, books).groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("dist").alias("error"),
        *[F.bit_or(F.when(F.floor(F.col("position") / 8) == w, byte).otherwise(F.lit(0).cast("long"))).alias(c) for w, c in enumerate(words)])
    digits = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in words])
    return Codes(whole.select("row", "vec_id", "label", F.substring(digits, 1, 2 * parts).alias("code"), "error"), books)


def label_totals(codes: DataFrame, value: str = "error", copies: int = 32) -> DataFrame:
    """codes with ``label_<value>``: its sum over the rows of equal label, nulls together.

    Totals come from partial sums; each is laid out ``copies`` times, and a label's rows
    spread over them, so a label of a third of all rows is no hot key of the join."""
    kept = C.written(codes, "codes-labels")
    total = kept.groupBy("label").agg(F.sum(value).alias(f"label_{value}")).select(
        F.col("label").alias("of"), f"label_{value}", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    rows = kept.withColumn("spread", F.pmod(F.xxhash64("row"), F.lit(copies)).cast("int"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("of")) & (F.col("spread") == F.col("copy"))).drop("of", "copy", "spread")


def sql() -> str:
    """DuckDB SQL of the query: every round as a table of distances."""
    def nearest_sql(k):
        return f"""a{k} AS MATERIALIZED (
  SELECT id, position, any_value(part) AS part, min(d * {ENTRIES} + entry) AS best
  FROM (SELECT p.id, p.position, p.part, c.entry,
               list_sum(list_transform(list_zip(p.part, c.part), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
        FROM parts p JOIN c{k} c ON p.position = c.position)
  GROUP BY id, position)"""

    def update_sql(k):
        return f"""c{k + 1} AS MATERIALIZED (
  SELECT c.position, c.entry, coalesce(m.part, c.part) AS part
  FROM c{k} c LEFT JOIN (
    SELECT position, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS part
    FROM (SELECT position, best % {ENTRIES} AS entry, j, sum(part[j])::BIGINT AS s, count(*) AS n
          FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT any_value(len(part)) FROM parts))) AS j) GROUP BY ALL)
    GROUP BY position, entry) m ON c.position = m.position AND c.entry = m.entry)"""

    rounds = ",\n".join(f"{nearest_sql(k)},\n{update_sql(k)}" for k in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT id, position, list_transform(embedding[position * w + 1:(position + 1) * w], lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS part
  FROM (SELECT id, embedding, len(embedding) // {PARTS} AS w, unnest(range({PARTS})) AS position FROM kept)),
c0 AS MATERIALIZED (SELECT position, id - 1 AS entry, part FROM parts WHERE id <= {ENTRIES}),
{rounds},
{nearest_sql(ROUNDS)},
codes AS (
  SELECT id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY position) AS code, sum(best // {ENTRIES})::BIGINT AS error
  FROM a{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY position, entry, j))
        FROM (SELECT position, entry, unnest(part) AS v, unnest(range(len(part))) AS j FROM c{ROUNDS})) AS codebooks_sha256
FROM codes JOIN kept USING (id)
"""
