"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

1. Equal vectors become one with a number of copies.
2. Spherical k-means on a sample of at most about ``sample`` vectors gives the
   cell centres (broadcast; at most sample / 20 of them per vector length).
   Every vector is assigned to its cell.
3. Cells are split into blocks of about ``BLOCK`` vectors by hash.  A vector is
   compared with its own block, the later blocks of its cell, and the blocks of
   those later cells c' that may hold a partner v' = cos * v + sin * w (w a unit vector
   across v).  Two bounds, both exact, rule out the others: v' is nearer to c' than to
   v's own centre c only if v * (c - c') / |c - c'| <= sin, and v' lies within the
   radius of c' only if the angle of v and c' is at most that radius and the
   angle of the partners together (the triangle inequality on the sphere).
   ``spread`` = z is an option that loses links: it takes w * (c' - c) / |c' - c| to be at
   most z / sqrt(d), as for directions that are uniform in all d dimensions.
4. Products are taken block by block in double precision.  A task holds one
   block and streams what is compared with it; it returns a count per vector and
   edges that connect, never all pairs.
5. Connected components of the edges; one vector (the least id) of each is kept.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, link with nothing and stand alone.  Vectors
of different length do not link.  Rows with the same id count as two vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C
from skycap.llm.components import connected_components, merge_join

BLOCK = 2048
SAMPLE = 20_000
PER_CELL = 2048
QUERIES = 1024
#: Rows that a task hands on at once.
ROWS = 8192


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # no overflow in the squares
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Unit centres; an empty cell takes the vector that fits its centre worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    last = None
    for _ in range(rounds):
        s = x @ c.T
        cell = s.argmax(axis=1)
        if last is not None and (cell == last).all():
            break
        last = cell
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        if len(empty):
            worst = np.argsort(s.max(axis=1))[:len(empty)]
            sums[empty], norm[empty] = x[worst], 1.0
        c = sums / norm[:, None]
    return c


#: Room for rounding in cosines and angles that rule out a cell.
SLACK = 1e-6


def _assign(centres):
    """Cell of each vector and the cosine with its centre."""

    def run(batches):
        cents = centres.value
        for b in batches:
            emb = b.column("emb")
            lens = np.asarray(pa.compute.list_value_length(emb))
            cell, fit = np.zeros(len(lens), np.int64), np.full(len(lens), -1.0)
            for d in np.unique(lens):
                at = np.flatnonzero(lens == d)
                c = cents.get(int(d))
                if c is None:
                    continue
                s = unit_rows(emb.take(pa.array(at)), int(d)) @ c.T
                cell[at] = s.argmax(axis=1)
                fit[at] = s.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), emb, b.column("copies"), pa.array(lens.astype(np.int64)), pa.array(cell), pa.array(fit)],
                ["id", "emb", "copies", "dim", "cell", "fit"])

    return run


def later_cells(x: np.ndarray, own: np.ndarray, c: np.ndarray, radius: np.ndarray, margin: float, angle: float) -> np.ndarray:
    """Which later cells may hold a partner of each unit vector."""
    s = x @ c.T
    gap = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    close = s[np.arange(len(x)), own][:, None] - s <= margin * gap[own] + SLACK
    close &= np.arccos(np.clip(s, -1, 1)) <= radius + angle + SLACK
    return close & (np.arange(len(c))[None, :] > own[:, None])


def _deal(units, centres, margin_of, angle: float):
    """A row per unit that a vector is a member of (kind 0) or compared with (kind 1)."""

    def run(batches):
        base, blocks, radius = units.value
        for b in batches:
            emb = b.column("emb")
            dims, cells = b.column("dim").to_numpy(), b.column("cell").to_numpy()
            near: list = [()] * len(dims)
            for d in np.unique(dims):
                c = centres.value.get(int(d))
                if c is None:
                    continue
                rows = np.flatnonzero(dims == d)
                reach = np.array([radius.get((int(d), j), -np.inf) for j in range(len(c))])
                for lo in range(0, len(rows), QUERIES):
                    part = rows[lo:lo + QUERIES]
                    x = unit_rows(emb.take(pa.array(part)), int(d))
                    for i, row in zip(part, later_cells(x, cells[part], c, reach, margin_of(int(d)), angle)):
                        near[i] = np.flatnonzero(row).tolist()
            def out(at, unit, kind):
                rows = pa.array(at)
                return pa.RecordBatch.from_arrays(
                    [pa.array(unit, pa.int64()), pa.array(kind, pa.int64()), *(b.column(c).take(rows) for c in ("id", "copies", "emb"))],
                    ["unit", "kind", "id", "copies", "emb"])

            at, unit, kind = [], [], []
            for i, (d, cell, h) in enumerate(zip(dims.tolist(), cells.tolist(), b.column("hash").to_pylist())):
                n = blocks[d, cell]
                own = h % n
                targets = [base[d, cell] + j for j in range(own, n)]
                for c in near[i]:
                    targets += range(base[d, c], base[d, c] + blocks[d, c]) if (d, c) in base else ()
                at += [i] * len(targets)
                unit += targets
                kind += [0] + [1] * (len(targets) - 1)
                while len(at) >= ROWS:  # a vector's copies grow with the units
                    yield out(at[:ROWS], unit[:ROWS], kind[:ROWS])
                    del at[:ROWS], unit[:ROWS], kind[:ROWS]
            if at:
                yield out(at, unit, kind)

    return run


class _Unit:
    """Members of one block and what was found for them."""

    def __init__(self):
        self.ids, self.copies, self.parts = [], [], []
        self.x = None

    def close(self):
        if self.x is None:
            self.x = np.concatenate(self.parts)
            self.id, self.weight = np.concatenate(self.ids), np.concatenate(self.copies)
            self.count = np.zeros(len(self.x), np.int64)
            self.label = np.arange(len(self.x))
            self.edges: list[tuple[int, int]] = []


def _compare(least: float):
    def links(u: _Unit, x, ids, weight, own: bool):
        """Counts of the queries; counts and labels of the members change."""
        out = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), QUERIES):
            hit = x[lo:lo + QUERIES] @ u.x.T >= least
            rows = np.arange(lo, min(len(x), lo + QUERIES))
            if own:
                hit[np.arange(len(rows)), rows] = False
            out[rows] = hit @ u.weight
            if not own:
                u.count += weight[rows] @ hit
            for r in np.flatnonzero(hit.any(axis=1)):
                members = np.flatnonzero(hit[r])
                roots = np.unique(u.label[np.append(members, rows[r])] if own else u.label[members])
                if len(roots) > 1:
                    u.label[np.isin(u.label, roots[1:])] = roots[0]
                if not own:
                    u.edges.append((int(ids[rows[r]]), int(u.id[roots[0]])))
        return out

    def table(ids, counts, edges):
        n, m = len(ids), len(edges)
        src = np.array([e[0] for e in edges] or [], np.int64)
        dst = np.array([e[1] for e in edges] or [], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, src])), pa.array(np.concatenate([counts, np.zeros(m, np.int64)])),
             pa.array(np.concatenate([np.zeros(n, np.int64), dst]), mask=np.arange(n + m) < n)], ["id", "n_links", "dst"])

    def finish(u: _Unit):
        u.close()
        joined = [(int(i), int(r)) for i, r in zip(u.id, u.id[u.label]) if i != r]
        return table(u.id, u.count, joined)

    def run(batches):
        unit, now = None, None
        for b in batches:
            units, kinds = b.column("unit").to_numpy(), b.column("kind").to_numpy()
            cut = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(units)]):
                if hi == lo:
                    continue
                if units[lo] != now:
                    if unit is not None:
                        yield from close(unit)
                    unit, now = _Unit(), units[lo]
                emb = b.column("emb").slice(lo, hi - lo)
                x = unit_rows(emb, len(emb[0]))
                ids, weight = b.column("id").to_numpy()[lo:hi], b.column("copies").to_numpy()[lo:hi]
                if kinds[lo] == 0:
                    unit.parts.append(x)
                    unit.ids.append(ids)
                    unit.copies.append(weight)
                    continue
                if unit.x is None:
                    yield from own(unit)
                counts = links(unit, x, ids, weight, False)
                yield table(ids, counts, unit.edges)  # now: a unit may meet links to all vectors
                unit.edges = []
        if unit is not None:
            yield from close(unit)

    def own(u: _Unit):
        u.close()
        u.count += links(u, u.x, u.id, u.weight, True)
        return ()

    def close(u: _Unit):
        if u.x is None:
            yield from own(u)
        yield finish(u)

    return run


def vector_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9,
                 sample: int = SAMPLE, spread: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    spark = vectors.sparkSession
    C.prepare(spark)
    angle = math.acos(min(1.0, max(-1.0, least)))
    sin = math.sin(angle) if least > 0 else 1.0
    margin = (lambda d: sin) if spread is None else (lambda d: min(sin, sin / max(least, 1e-9) * spread / math.sqrt(d)))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("emb"))
    # a NaN is greater than infinity in comparisons
    fine = F.coalesce(F.col("id").isNotNull() & F.forall("emb", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
                      & F.exists("emb", lambda v: v != 0), F.lit(False))
    keyed = rows.select("id", "emb", fine.alias("fine"), F.xxhash64("emb").alias("k1"), F.xxhash64(F.lit(1), "emb").alias("k2"))
    reps = C.written(keyed.where("fine").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.first("emb").alias("emb"), F.count("*").alias("copies")), "vectors")
    n = reps.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    picked = reps.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share).select("emb").toArrow().column("emb").combine_chunks()
    centres: dict[int, np.ndarray] = {}
    if len(picked):
        lens = np.asarray(pa.compute.list_value_length(picked))
        for d in np.unique(lens):
            x = unit_rows(picked.take(pa.array(np.flatnonzero(lens == d))), int(d))
            k = max(1, min(len(x) // 20, math.ceil(n * len(x) / len(picked) / PER_CELL)))
            centres[int(d)] = spherical_kmeans(x, k)
    cents = spark.sparkContext.broadcast(centres)
    kind = dict(reps.dtypes)["emb"]
    placed = C.written(reps.select("id", "emb", "copies").mapInArrow(
        _assign(cents), f"id long, emb {kind}, copies long, dim long, cell long, fit double"), "vector-cells")
    base, blocks, radius, at = {}, {}, {}, 0
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("fit").alias("fit"))
    for r in sizes.orderBy("dim", "cell").collect():  # bounded by the number of centres
        key = (r["dim"], r["cell"])
        base[key], blocks[key] = at, math.ceil(r["n"] / BLOCK)
        radius[key] = math.acos(min(1.0, max(-1.0, r["fit"])))
        at += blocks[key]
    units = spark.sparkContext.broadcast((base, blocks, radius))
    dealt = placed.withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInArrow(
        _deal(units, cents, margin, angle), f"unit long, kind long, id long, copies long, emb {kind}")
    found = C.written(dealt.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(
        _compare(least), "id long, n_links long, dst long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    edges = found.where("dst is not null").select(F.col("id").alias("src"), "dst").distinct()
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    comps = connected_components(ends, edges)
    result = merge_join(merge_join(reps.select("k1", "k2", "id", "copies"), counts, "id"), comps, "id", "left").select(
        "k1", "k2", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    out = keyed.select("id", "fine", F.when(F.col("fine"), F.col("k1")).alias("k1"), F.when(F.col("fine"), F.col("k2")).alias("k2"))
    # rows that link with nothing have a null key and pass the outer join alone
    return out.join(result, ["k1", "k2"], "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"))
