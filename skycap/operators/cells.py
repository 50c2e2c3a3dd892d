"""Neighbour join within a radius, partitioned around pivots.

Vectors are compared by cosine distance; on the unit sphere a distance of at most
eps is a chord of at most r = sqrt(2 eps).  Every query belongs to the cell of its
nearest pivot.  A candidate x goes to each cell whose queries it may reach:

* its distance to the hyperplane between the cell's pivot p and its own nearest
  pivot o, (|x - p|^2 - |x - o|^2) / (2 |p - o|), is at most r, and
* |x - p| is at most the cell's radius plus r.

Both bounds are exact, so each pair within eps meets in one cell, the query's, and
counts may be added up.  Clustered vectors meet few others; where nothing can be
ruled out a candidate goes to all cells, about as often as to all blocks of the
plain block join.  A crowded cell is split into blocks on both sides, so a task's
memory is bounded by ``block_rows`` whatever the data.

Pivots are ``n_blocks`` rows (``MAX_PIVOTS`` at most) of least hash; they and a row
of counts a cell are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.operators.pairs import TILED_BLOCK_ROWS, auto_block_rows, n_blocks, stack
from skycap.session import ensure_checkpoint_dir, ship_package

MAX_PIVOTS = 1024
#: Rounding of the bounds, far above that of doubles.
SLACK = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * x @ p.T
    return np.sqrt(np.maximum(d2, 0.0))


class Cells:
    """Pivots over points (id, v) and the radius of a join."""

    def __init__(self, points: DataFrame, eps: float, block_rows: int | None = None, n_rows: int | None = None):
        self.spark = points.sparkSession
        ensure_checkpoint_dir(self.spark)
        ship_package(self.spark)
        n = points.count() if n_rows is None else n_rows
        self.block_rows = block_rows or auto_block_rows(n, self.spark.sparkContext.defaultParallelism, TILED_BLOCK_ROWS)
        self.radius = float(np.sqrt(2.0 * max(0.0, eps))) + SLACK
        some = points.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(MAX_PIVOTS, n_blocks(n, self.block_rows))).select("v").collect()
        self.pivots = np.unique(unit(np.array([r.v for r in some], float)), axis=0) if some else np.zeros((0, 1))

    def _with(self, df: DataFrame, add: Callable[[np.ndarray], dict], columns: str) -> DataFrame:
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(**add(unit(stack(pdf["v"]))))

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(run, f"{kept}, {columns}")

    def home(self, queries: DataFrame) -> DataFrame:
        """queries with cell and far (distance to its pivot)."""
        sent = self.spark.sparkContext.broadcast(self.pivots)

        def add(x):
            d = _distances(x, sent.value)
            cell = d.argmin(axis=1)
            return {"cell": cell.astype(np.int32), "far": d[np.arange(len(x)), cell]}

        return self._with(queries, add, "cell int, far double")

    def reach(self, cands: DataFrame, radii: dict[int, float]) -> DataFrame:
        """cands with cells, the list of cells whose queries may be within the radius."""
        p, r = self.pivots, self.radius
        least = np.full(len(p), -np.inf)
        least[list(radii)] = list(radii.values())
        sent = self.spark.sparkContext.broadcast((p, least, np.maximum(2.0 * _distances(p, p), 1e-300)))

        def add(x):
            p, least, twice = sent.value
            d = _distances(x, p)
            own = d.argmin(axis=1)
            ok = d <= least[None, :] + r + SLACK
            ok &= d * d - (d[np.arange(len(x)), own] ** 2)[:, None] <= twice[own] * (r + SLACK) + SLACK
            at, cell = np.nonzero(ok)
            return {"cells": np.split(cell.astype(np.int32), np.searchsorted(at, np.arange(1, len(x))))}

        return self._with(cands, add, "cells array<int>")

    def dealt(self, queries: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides by (cell, qblk, cblk)."""
        q = self.home(queries).checkpoint(eager=True)
        of = q.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row a cell
        c = self.reach(cands, {r.cell: r.far for r in of}).checkpoint(eager=True)
        in_cell = {r.cell: r.n for r in c.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
        sizes = self.spark.createDataFrame([(r.cell, n_blocks(r.n, self.block_rows), n_blocks(in_cell.get(r.cell, 1), self.block_rows))
                                            for r in of] or [(-1, 1, 1)], "cell int, nq int, nc int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = lambda c, n: F.pmod(F.xxhash64(c, F.lit(31)), F.col(n)).cast("int")
        q = q.drop("far").join(F.broadcast(sizes), "cell").withColumn("qblk", block("id", "nq")).withColumn("cblk", upto("nc"))
        c = c.withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(sizes), "cell").withColumn(
            "cblk", block("id", "nc")).withColumn("qblk", upto("nq"))
        return q.drop("nq", "nc"), c.drop("nq", "nc")

    def pairs(self, queries: DataFrame, cands: DataFrame, kernel, schema: str) -> DataFrame:
        """``kernel(queries, candidates)`` on frames with id and v (and what else the sides
        hold); every pair within the radius is in one call."""
        q, c = self.dealt(queries, cands)

        def run(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
            if len(qpdf) == 0 or len(cpdf) == 0:
                return pd.DataFrame(columns=[f.split()[0] for f in schema.split(",")])
            return kernel(qpdf, cpdf)

        keys = ["cell", "qblk", "cblk"]
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(run, schema)


#: Rows of a block that are scored against the other block at once.
STRIP = 256


def strips(qpdf: pd.DataFrame, cpdf: pd.DataFrame, eps: float):
    """(rows of the queries, which candidates are within eps of each), strip by strip."""
    x, y = unit(stack(qpdf["v"])), unit(stack(cpdf["v"]))
    for lo in range(0, len(x), STRIP):
        yield slice(lo, lo + STRIP), (1.0 - x[lo:lo + STRIP] @ y.T) <= eps


def count_kernel(eps: float):
    def kernel(qpdf, cpdf):
        n = np.concatenate([near.sum(axis=1) for _, near in strips(qpdf, cpdf, eps)])
        return pd.DataFrame({"id": qpdf["id"].to_numpy(np.int64), "n": n.astype(np.int64)})
    return kernel


def forest_kernel(eps: float):
    """Links of one block pair as stars: every node to the least id that it is connected
    with, by rounds of least labels over whole rows and columns; links are kept as bits."""
    def kernel(qpdf, cpdf):
        links = [(s, np.packbits(near, axis=1)) for s, near in strips(qpdf, cpdf, eps)]
        qid, cid = qpdf["id"].to_numpy(np.int64), cpdf["id"].to_numpy(np.int64)
        nodes = np.unique(np.concatenate([qid, cid]))
        qi, ci = np.searchsorted(nodes, qid), np.searchsorted(nodes, cid)
        label = np.arange(len(nodes), dtype=np.int32)
        none = np.int32(len(nodes))
        while True:
            before = label.copy()
            for s, bits in links:
                near = np.unpackbits(bits, axis=1, count=len(cid)).view(bool)
                np.minimum.at(label, qi[s], np.where(near, label[ci][None, :], none).min(axis=1))
                np.minimum.at(label, ci, np.where(near, label[qi[s]][:, None], none).min(axis=0))
            label = label[label]
            if (label == before).all():
                break
        linked = label != np.arange(len(nodes))
        return pd.DataFrame({"src": nodes[linked], "dst": nodes[label[linked]]})
    return kernel


def least_label_kernel(eps: float):
    def kernel(qpdf, cpdf):
        none = np.iinfo(np.int64).max
        labels = cpdf["label"].to_numpy(np.int64)[None, :]
        best = np.concatenate([np.where(near, labels, none).min(axis=1) for _, near in strips(qpdf, cpdf, eps)])
        keep = best != none
        return pd.DataFrame({"id": qpdf["id"].to_numpy(np.int64)[keep], "label": best[keep]})
    return kernel
