"""Retrieval evaluation (j07, j08, w01, w02, t01, a14-a18).

Every metric is computed exactly from the blocked kernel of
``skycap.operators.pairs``:

* Recall@K (exact identity): rank of the true match = 1 + number of
  candidates scoring above it (id breaks ties), summed over blocks.
* MRR (relevance >= threshold): pass 1 finds the best-scoring relevant
  candidate; where it is not among the first K, pass 2 counts those above it.
* nDCG@K: per block top-K by similarity and top-K relevances, merged.
* Relevance statistics: count / sum / max of positive relevances.
* The full ranking has a row a pair: block pairs emit packed similarities, which
  are sorted by query.

Relevance is ``weather_similarity`` of the parsed captions (parsed once per
sample, before pairing), with the diagonal and identical captions at 1.0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycap.functions import parse as P
from skycap.functions.scoring import Weights, dot, np_score, season_index
from skycap.operators.pairs import TILE, auto_block_rows, block_pairs, n_blocks, stack
from skycap.session import ensure_checkpoint_dir, kept

DEFAULT_K = [1, 5, 10]


def parse_features(df: DataFrame, caption: str = "caption") -> DataFrame:
    """Parse each caption once and encode the fields the relevance uses."""
    p = P.parse_caption(F.col(caption))
    regions = F.array(*[F.lit(r) for r in P.REGION_PATTERNS])
    conds = F.array(*[F.lit(c) for c in P.CONDITION_TERMS])
    return df.withColumn("_p", p).select(
        "*",
        (F.array_position(regions, F.col("_p.region")) - 1).cast("int").alias("f_region"),
        F.when(F.col("_p.season") != P.UNKNOWN, F.coalesce(season_index(F.col("_p.season")), F.lit(-1)))
        .otherwise(F.lit(-1)).cast("int").alias("f_season"),
        F.col("_p.avg_temperature").alias("f_temp"),
        (F.array_position(conds, F.col("_p.conditions")) - 1).cast("int").alias("f_cond"),
        F.xxhash64(F.col(caption)).alias("f_cap1"), F.xxhash64(F.lit(1), F.col(caption)).alias("f_cap2"),
    ).drop("_p")


#: What the relevance compares; a caption travels as 128 hash bits, not as text.
_FEATS = ["f_region", "f_season", "f_temp", "f_cond", "f_cap1", "f_cap2"]
VECS = ("image_emb", "text_emb")
#: Similarities equal to so many decimals are ties (the smaller id comes first), whatever a block's shape does to the last bits.
DECIMALS = 12
#: Cells whose products are computed again at once.
CELLS = 1 << 14
#: Most rows of a block, which is scored tile by tile: vectors are sent once per block of the other side.
BLOCK_ROWS = 32768


def _side(df: DataFrame, id_name: str, vec: str) -> DataFrame:
    """One vector and the features of each sample."""
    return df.select(F.col("idx").alias(id_name), F.col(vec).cast("array<double>").alias("vec"), "self", *_FEATS)


class _Feats:
    """What the relevances of a block's rows follow from: the temperature, and the few distinct values of the rest."""

    def __init__(self, pdf: pd.DataFrame):
        self.temp = pdf["f_temp"].to_numpy(np.float64, na_value=np.nan)
        codes = np.column_stack([pdf[c].fillna(-1).to_numpy(np.int64) for c in ("f_region", "f_season", "f_cond")])
        kinds, at = np.unique(codes, axis=0, return_inverse=True)
        self.kinds, self.at = kinds, at.reshape(-1)

    def part(self, region: bool, conditions: bool) -> dict:
        """The kinds as ``np_relevance`` takes them, with all but some fields unknown."""
        none = np.full(len(self.kinds), -1)
        r, s, c = self.kinds.T
        return {"region": r if region else none, "season": s if region else none, "conditions": c if conditions else none,
                "temp": np.full(len(none), np.nan)}


class _Relevances:
    """Tiles of ``np_relevance`` between two blocks, to the last bit: the sums of its parts in its order, with the parts
    of region, season and conditions looked up by kind."""

    def __init__(self, q: _Feats, c: _Feats, weights: Weights):
        self.q, self.c, self.w = q, c, weights
        table = lambda region, conditions: np_score(q.part(region, conditions), c.part(region, conditions), weights)
        self.first, self.last = table(True, False), table(False, True)

    def tile(self, p: slice, r: slice) -> np.ndarray:
        w = self.w
        if w.total <= 0:
            return np.zeros((len(self.q.temp[p]), len(self.c.temp[r])))
        d = np.abs(self.q.temp[p, None] - self.c.temp[None, r])
        far = ~(d <= w.tolerance)  # also without a temperature
        if w.tolerance > 0:
            d /= w.tolerance
            np.subtract(1.0, d, out=d)
        else:
            d[:] = 1.0
        d *= w.temperature
        d[far] = 0.0
        d += self.first[self.q.at[p]][:, self.c.at[r]]
        d += self.last[self.q.at[p]][:, self.c.at[r]]
        d /= w.total
        return d

    def at(self, p: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The same of single cells: rows p, columns r."""
        w = self.w
        if w.total <= 0:
            return np.zeros(len(p))
        d = np.abs(self.q.temp[p] - self.c.temp[r])
        far = ~(d <= w.tolerance)
        d = (1.0 - d / w.tolerance if w.tolerance > 0 else np.ones(len(d))) * w.temperature
        d[far] = 0.0
        a, b = self.q.at[p], self.c.at[r]
        return ((d + self.first[a, b]) + self.last[a, b]) / w.total


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells, row by row; eight cells without a true one are passed over at once."""
    if mask.size % 8 or not mask.flags.c_contiguous:
        return np.divmod(np.flatnonzero(mask), mask.shape[1])
    some = np.flatnonzero(mask.reshape(-1).view(np.uint64))
    eight, cell = np.nonzero(mask.reshape(-1, 8)[some])
    return np.divmod(8 * some[eight] + cell, mask.shape[1])


def _slack(bound: np.ndarray) -> np.ndarray:
    """``bound`` less what rounding to ``DECIMALS`` may move: a product below cannot round to ``bound`` or more."""
    return bound - 2.0 * 10.0 ** -DECIMALS - 1e-15 * np.abs(np.where(np.isinf(bound), 0.0, bound))


class _Products:
    """Products of the rows of x and y, tile by tile: in single precision with a bound of its error, single cells in
    double.  What single precision cannot hold is multiplied in double."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        nx, ny = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
        most = [v.max(initial=0.0) for v in (nx, ny)]
        single = all(v < 1e15 for v in most)  # not so for NaN
        self.a, self.b = (v.astype(np.float32) if single else v for v in (x, y))
        self.sim = np.empty(TILE * TILE, self.a.dtype)  # one tile at a time
        # both factors, their product and the sum are rounded
        unit = (x.shape[1] + 4) * 2.0 ** -24 if single else 0.0
        self.row_err, self.col_err = (unit * nx * most[1], unit * ny * most[0]) if single else (np.zeros(len(x)), np.zeros(len(y)))

    def tile(self, q: slice, c: slice):
        """The tile's products, which the next tile takes the place of, and a function for rounded ones of some of its cells."""
        x, y = self.x[q], self.y[c]
        whole: list[np.ndarray] = []

        def values(r: np.ndarray, k: np.ndarray) -> np.ndarray:
            if not whole and len(r) <= len(x) * len(y) >> 5:
                return np.round(np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", x[r[i:i + CELLS]], y[k[i:i + CELLS]])
                                                                for i in range(0, len(r), CELLS)]), DECIMALS)
            if not whole:
                whole.append(x @ y.T)
            return np.round(whole[0][r, k], DECIMALS)

        sim = self.sim[:len(x) * len(y)].reshape(len(x), len(y))
        return np.matmul(self.a[q], self.b[c].T, out=sim), values


class _Tile:
    """Products of queries (rows) and candidates (columns).  ``sim`` differs from them by ``err`` of the query at most;
    with ``across`` it has the candidates as rows."""

    def __init__(self, sim: np.ndarray, values, err: np.ndarray, across: bool = False):
        self.sim, self._values, self.err, self.across = sim, values, err, across
        self.shape = sim.shape[::-1] if across else sim.shape

    def _bounds(self, bound: np.ndarray, to: float) -> np.ndarray:
        """A bound a query in the products' type, rounded towards ``to``."""
        if self.sim.dtype == np.float32:
            bound = np.nextafter(bound.astype(np.float32), np.float32(to))
        return bound[None, :] if self.across else bound[:, None]

    def reach(self, bound: np.ndarray) -> np.ndarray:
        """Where a product may be its query's bound or more (no cell of such a product is missing)."""
        return self.sim >= self._bounds(bound - self.err, -np.inf)

    def exceed(self, bound: np.ndarray) -> np.ndarray:
        """Where a product is above its query's bound whatever the error."""
        return self.sim > self._bounds(bound + self.err, np.inf)

    def cells(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and rounded products of the true cells."""
        i, j = _where(mask)
        v = self._values(i, j)
        return (j, i, v) if self.across else (i, j, v)

    def least_of_top(self, k: int) -> np.ndarray:
        """Per query a product that k others reach at least."""
        return _least_of_top(np.ascontiguousarray(self.sim.T) if self.across else self.sim, k).astype(np.float64) - self.err


def _counted(r: np.ndarray, c: np.ndarray, v: np.ndarray, bound: np.ndarray, ids: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """Per row the given cells above ``bound``, or equal to it with an id below the row's; never those of the row's own id."""
    ok = ((v > bound[r]) | ((v == bound[r]) & (cid[c] < ids[r]))) & (cid[c] != ids[r])
    return np.bincount(r[ok], minlength=len(bound))


def _above(tile: _Tile, bound: np.ndarray, ids: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """Per row the columns whose rounded similarity is above ``bound``, or equals it with an id below the row's;
    a column with the row's own id never counts.  Only what lies near the bound is looked up and rounded."""
    near = tile.reach(_slack(bound))
    count = np.zeros(len(bound), np.int64)
    if np.count_nonzero(near) > near.size >> 7:  # far above it nothing depends on rounding
        far = tile.exceed(2.0 * bound - _slack(bound))
        near &= ~far
        mine = far.T if tile.across else far
        count += mine.sum(axis=1)
        first, last = np.searchsorted(cid, ids), np.searchsorted(cid, ids, "right")
        for i in np.flatnonzero(first < last):
            count[i] -= mine[i, first[i]:last[i]].sum()
    return count + _counted(*tile.cells(near), bound, ids, cid)


def _least_of_top(values: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that k others reach at least and that few exceed: the k-th of the greatest of every 64 columns."""
    width = values.shape[1]
    if width <= 64 * k:
        return np.partition(values, width - k, axis=1)[:, width - k]
    tops = np.maximum.reduceat(values, np.arange(0, width, 64), axis=1)
    return np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]


def _first_by(rows: np.ndarray, k: int) -> np.ndarray:
    """Of sorted row numbers, where each one's first k stand."""
    start = np.flatnonzero(np.diff(rows, prepend=-1))
    return np.flatnonzero(np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows)))) < k)


def top_columns(values: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k greatest values, greatest first, equal ones by column."""
    r, c = _where(values >= _least_of_top(values, k)[:, None])
    order = np.lexsort((c, -values[r, c], r))
    return c[order][_first_by(r[order], k)].reshape(len(values), k)


PHASE1_SCHEMA = ("dir string, qid long, n long, better_self long, best_sim double, best_cid long, "
                 "top array<struct<neg_sim:double,cid:long,rel:double>>, ideal array<double>, "
                 "pos_n long, pos_sum double, pos_max double")


RANK_SCHEMA = PHASE1_SCHEMA.split(", ideal")[0]


class _Partials:
    """The partials of one block's queries against another block, tile by tile; columns are in order of their ids.

    Similarities are compared in single precision, once for the least of a query's bounds: the own similarity (rank), the
    best relevant one so far, the k-th so far.  Only cells that may reach it are computed in double and rounded.  Where
    they are many, the rank is counted apart.  Relevances are looked up where they matter; ``relevance`` gives all.

    The own candidate is relevant, so what scores below it is never the best relevant one."""

    def __init__(self, qid: np.ndarray, cid: np.ndarray, self_: np.ndarray, k_max: int, threshold: float, rel_at):
        n = len(qid)
        self.qid, self.cid, self.self_, self.k, self.threshold = qid, cid, self_, min(k_max, len(cid)), threshold
        self.rel_at = rel_at
        self.floor = _slack(np.where(np.isnan(self_), -np.inf, self_))
        self.better, self.pos_n = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.best_sim, self.best_cid = np.full(n, -np.inf), np.zeros(n, np.int64)
        self.pos_sum, self.pos_max = np.zeros(n), np.full(n, -np.inf)
        self.tops: dict[int, list[tuple]] = {}  # by first row of the tile: rows, rounded similarities, columns
        self.kth = np.full(n, -np.inf)
        self.ideal: list[tuple] = []

    def add(self, lo: int, at: int, tile: _Tile) -> None:
        rows, columns = tile.shape
        q, cid = slice(lo, lo + rows), self.cid[at:at + columns]
        best, own, floor = self.best_sim[q], self.self_[q], self.floor[q]
        top = self.kth[q] if lo in self.tops else tile.least_of_top(min(self.k, columns))
        low = np.fmin(_slack(top), np.maximum(floor, _slack(best)))
        cells = tile.reach(np.fmin(low, _slack(own)))
        if np.count_nonzero(cells) <= cells.size >> 6:
            r, c, v = tile.cells(cells)
            self.better[q] += _counted(r, c, v, own, self.qid[q], cid)
        else:
            self.better[q] += _above(tile, own, self.qid[q], cid)
            r, c, v = tile.cells(tile.reach(low))
        self._add_top(lo, at, rows, r, c, v)
        better = (v > best[r]) & (v >= floor[r])  # tiles come in order of their ids: of equal ones the first stays
        r, c, v = r[better], c[better], v[better]
        ok = self.rel_at(r + lo, c + at) >= self.threshold
        r, c, v = r[ok], c[ok], v[ok]
        order = np.lexsort((c, -v, r))
        one = order[_first_by(r[order], 1)]
        self.best_sim[r[one] + lo], self.best_cid[r[one] + lo] = v[one], cid[c[one]]

    def _add_top(self, lo: int, at: int, rows: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> None:
        mine = self.tops.setdefault(lo, [])
        new = v > self.kth[lo + r]  # of equal ones those of the tiles before come first
        mine.append((r[new], v[new], c[new] + at))
        size = sum(len(x[0]) for x in mine)
        if size > 3 * self.k * rows or len(mine) == 1:
            self._merge_top(lo, rows)

    def _merge_top(self, lo: int, rows: int) -> None:
        """The first k of each row so far, and the k-th."""
        r, v, c = (np.concatenate(x) for x in zip(*self.tops[lo]))
        order = np.argsort(-v, kind="stable")  # of a row's equal ones those of lower columns come first already
        order = order[np.argsort(r[order].astype(np.int16), kind="stable")]
        order = order[_first_by(r[order], self.k)]
        r, v, c = r[order], v[order], c[order]
        self.tops[lo] = [(r, v, c)]
        full = np.flatnonzero(np.bincount(r, minlength=rows) == self.k)
        self.kth[lo + full] = v[np.searchsorted(r, full, "right") - 1]

    def relevance(self, lo: int, rel: np.ndarray) -> None:
        """Statistics and greatest ones of a tile of all relevances."""
        rows, q, k = np.arange(len(rel)), slice(lo, lo + len(rel)), min(self.k, rel.shape[1])
        least = _least_of_top(rel, k)
        r, c = _where(rel > least[:, None])
        self.ideal.append((np.concatenate([r, np.repeat(rows, k)]) + lo, -np.concatenate([rel[r, c], np.repeat(least, k)])))
        self.pos_n[q] += (rel > 0).sum(axis=1)
        self.pos_sum[q] += np.maximum(rel, 0.0).sum(axis=1)
        self.pos_max[q] = np.maximum(self.pos_max[q], rel.max(axis=1))

    def frame(self, name: str) -> pd.DataFrame:
        n, k = len(self.qid), self.k
        for lo in self.tops:
            self._merge_top(lo, min(TILE, n - lo))
        row, sim, col = (np.concatenate(x) for x in zip(*[(r + lo, v, c) for lo in sorted(self.tops) for r, v, c in self.tops[lo]]))
        shaped = lambda x: x.reshape(n, k)
        top = zip(shaped(-sim), shaped(self.cid[col]), shaped(self.rel_at(row, col)))
        has = self.best_sim > -np.inf
        out = pd.DataFrame({
            "dir": name, "qid": self.qid, "n": np.full(n, len(self.cid), dtype=np.int64), "better_self": self.better,
            "best_sim": np.where(has, self.best_sim, np.nan), "best_cid": pd.array(self.best_cid, dtype="Int64"),
            "top": [[{"neg_sim": a, "cid": int(b), "rel": c} for a, b, c in zip(*x)] for x in top]})
        out.loc[~has, "best_cid"] = pd.NA
        if self.ideal:
            irow, ineg = (np.concatenate(x) for x in zip(*self.ideal))
            best = np.lexsort((ineg, irow))
            best = shaped(best[_first_by(irow[best], k)])
            out = out.assign(ideal=list(-ineg[best]), pos_n=self.pos_n, pos_sum=self.pos_sum, pos_max=np.where(self.pos_n > 0, self.pos_max, np.nan))
        return out


def _phase1_kernel(k_max: int, threshold: float, directions: list[tuple[str, str, str]], weights: Weights = Weights(),
                   relevance: bool = True):
    """Images of one block against texts of another, tile by tile, for one direction or both.  Without ``relevance``
    the statistics over all relevances (ideal, pos_*) are left to ``_relevance_rows``."""
    names = [name for name, *_ in directions]

    def kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        qpdf, cpdf = qpdf.sort_values("qid"), cpdf.sort_values("cid")
        keys = np.concatenate([p[["f_cap1", "f_cap2"]].to_numpy(np.int64) for p in (qpdf, cpdf)])
        codes = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1).astype(np.int32)
        qcap, ccap = codes[:len(qpdf)], codes[len(qpdf):]
        qid, cid = qpdf["qid"].to_numpy(np.int64), cpdf["cid"].to_numpy(np.int64)
        products = _Products(stack(qpdf["vec"]), stack(cpdf["vec"]))
        relevances = _Relevances(_Feats(qpdf), _Feats(cpdf), weights)

        def rel_at(r, c):
            rel = relevances.at(r, c)
            rel[(qcap[r] == ccap[c]) | (qid[r] == cid[c])] = 1.0
            return rel

        side = lambda *a: _Partials(*a[:2], a[2]["self"].to_numpy(np.float64), k_max, threshold, a[3])
        rows = side(qid, cid, qpdf, rel_at) if I2T[0] in names else None
        cols = side(cid, qid, cpdf, lambda r, c: rel_at(c, r)) if T2I[0] in names else None
        for lo in range(0, len(qid), TILE):
            q = slice(lo, lo + TILE)
            for at in range(0, len(cid), TILE):
                c = slice(at, at + TILE)
                sim, values = products.tile(q, c)
                if rows is not None:
                    rows.add(lo, at, _Tile(sim, values, products.row_err[q]))
                if cols is not None:
                    cols.add(at, lo, _Tile(sim, values, products.col_err[c], across=True))
                if relevance:
                    rel = relevances.tile(q, c)
                    rel[(qcap[q, None] == ccap[None, c]) | (qid[q, None] == cid[None, c])] = 1.0
                    if rows is not None:
                        rows.relevance(lo, rel)
                    if cols is not None:
                        cols.relevance(at, np.ascontiguousarray(rel.T))
        return pd.concat([p.frame(name) for p, name in ((rows, I2T[0]), (cols, T2I[0])) if p is not None], ignore_index=True)

    return kernel


# --- relevances of all pairs, by classes of equal features -------------------
_CLASS = _FEATS[:4]
CLASS_SCHEMA = "qid long, own double, ideal array<double>, pos_n long, pos_sum double, pos_max double"


def _class_kernel(k: int, weights: Weights):
    """Relevances of one block of classes to another, each class counted as often as it has rows (``m``); a class's
    relevance to itself is given apart."""
    def kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        cpdf = cpdf.sort_values("cid")
        qid, cid, m = qpdf["qid"].to_numpy(np.int64), cpdf["cid"].to_numpy(np.int64), cpdf["m"].to_numpy(np.int64)
        relevances = _Relevances(_Feats(qpdf), _Feats(cpdf), weights)
        out = []
        for lo in range(0, len(qid), TILE):
            q = slice(lo, lo + TILE)
            n = len(qid[q])
            own, pos_n, pos_sum, pos_max = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n), np.full(n, -np.inf)
            ideal = []
            for at in range(0, len(cid), TILE):
                c = slice(at, at + TILE)
                rel, times = relevances.tile(q, c), m[c]
                j = np.searchsorted(cid[c], qid[q])
                j[j == len(times)] = 0
                mine = np.flatnonzero(cid[c][j] == qid[q])
                own[mine] = rel[mine, j[mine]]
                rel[mine, j[mine]] = -np.inf
                pos_n += (rel > 0) @ times
                pos_sum += np.maximum(rel, 0.0) @ times
                pos_max = np.maximum(pos_max, rel.max(axis=1))
                col = top_columns(rel, min(k, rel.shape[1]))
                r, col = np.repeat(np.arange(n), col.shape[1]), col.ravel()
                often = np.minimum(times[col], k)
                ideal.append((np.repeat(r, often), np.repeat(rel[r, col], often)))
            r, v = (np.concatenate(x) for x in zip(*ideal))
            r, v = r[v > -np.inf], v[v > -np.inf]
            order = np.lexsort((-v, r))
            order = order[_first_by(r[order], k)]
            r, v = r[order], v[order]
            out.append(pd.DataFrame({"qid": qid[q], "own": own, "ideal": np.split(v, np.searchsorted(r, np.arange(1, n))) if n > 1 else [v],
                                     "pos_n": pos_n, "pos_sum": pos_sum, "pos_max": np.where(pos_max > -np.inf, pos_max, np.nan)}))
        return pd.concat(out, ignore_index=True)

    return kernel


def _best(column, k: int) -> Column:
    return F.slice(F.sort_array(column, asc=False), 1, k)


def _relevance_rows(samples: DataFrame, k_max: int, weights: Weights) -> DataFrame:
    """(qid, ideal, pos_n, pos_sum, pos_max) over all pairs, for both directions: relevance depends on four features
    and on equal captions only, so classes of equal features are compared instead of rows.  Each id must have one caption."""
    code = [F.coalesce(c, F.lit(-1)).alias(c) if c != "f_temp" else F.col(c) for c in _CLASS]
    rows = samples.select("idx", *code, "f_cap1", "f_cap2")
    classes = kept(rows.groupBy(*_CLASS).agg(F.count("*").alias("m")))
    classes = kept(classes.withColumn("cid", F.monotonically_increasing_id()))
    pairs = block_pairs(classes.withColumnRenamed("cid", "qid").drop("m"), classes, _class_kernel(k_max, weights), CLASS_SCHEMA,
                        block_rows=auto_block_rows(classes.count(), 2 * samples.sparkSession.sparkContext.defaultParallelism, BLOCK_ROWS))
    found = pairs.groupBy("qid").agg(F.max("own").alias("own"), _best(F.flatten(F.collect_list("ideal")), k_max).alias("ideal"),
                                     F.sum("pos_n").alias("pos_n"), F.sum("pos_sum").alias("pos_sum"), F.max("pos_max").alias("pos_max"))
    found = classes.join(found.withColumnRenamed("qid", "cid"), "cid").drop("cid").toDF(*[f"_{c}" for c in _CLASS], "m", *found.columns[1:])
    like = rows.groupBy("f_cap1", "f_cap2").agg(F.count("*").alias("same"))
    alike = F.lit(True)
    for c in _CLASS:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rest = F.col("m") - F.col("same")  # of the same class with other captions
    upto = lambda c: F.least(c, F.lit(k_max)).cast("int")
    each = rows.join(like, ["f_cap1", "f_cap2"]).join(found, alike).select(
        F.col("idx").alias("qid"),
        _best(F.concat(F.array_repeat(F.lit(1.0), upto(F.col("same"))), F.array_repeat("own", upto(rest)), "ideal"), k_max).alias("ideal"),
        (F.col("pos_n") + F.col("same") + F.when(F.col("own") > 0, rest).otherwise(0)).alias("pos_n"),
        (F.col("pos_sum") + F.col("same") + F.greatest("own", F.lit(0.0)) * rest).alias("pos_sum"),
        F.greatest(F.lit(1.0), "pos_max", F.when(rest > 0, F.col("own"))).alias("pos_max"))
    return each.groupBy("qid").agg(_best(F.flatten(F.collect_list("ideal")), k_max).alias("ideal"), F.sum("pos_n").alias("pos_n"),
                                   F.sum("pos_sum").alias("pos_sum"), F.max("pos_max").alias("pos_max"))


PHASE2_SCHEMA = "qid long, above_best long"


def _phase2_kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
    cpdf = cpdf.sort_values("cid")
    cid, products = cpdf["cid"].to_numpy(np.int64), _Products(stack(qpdf["vec"]), stack(cpdf["vec"]))
    best, first = qpdf["best_sim"].to_numpy(np.float64), qpdf["best_cid"].to_numpy(np.int64)
    above = np.zeros(len(best), np.int64)
    for lo in range(0, len(best), TILE):
        q = slice(lo, lo + TILE)
        for at in range(0, len(cid), TILE):  # the best one itself is not above itself
            c = slice(at, at + TILE)
            above[q] += _above(_Tile(*products.tile(q, c), products.row_err[q]), best[q], first[q], cid[c])
    return pd.DataFrame({"qid": qpdf["qid"].to_numpy(np.int64), "above_best": above})


def materialise_samples(samples: DataFrame) -> DataFrame:
    """Project what the kernel needs and write it to the checkpoint folder
    once: every later pass reads it instead of re-deriving and re-parsing, and
    lineage stays short."""
    ensure_checkpoint_dir(samples.sparkSession)
    return samples.select("idx", *VECS, F.round(dot("image_emb", "text_emb"), DECIMALS).alias("self"), *_FEATS).repartition("idx").checkpoint(eager=True)


I2T = ("i2t", "image_emb", "text_emb")
T2I = ("t2i", "text_emb", "image_emb")


def ranked_partials(samples: DataFrame, directions: list[tuple[str, str, str]] | None = None, *, k_max: int = 10,
                    threshold: float = 0.8, block_rows: int | None = None, weights: Weights = Weights(),
                    similarity: bool = True) -> DataFrame:
    """Per-(direction, query) merged partials: one block-pair pass that serves
    both directions, and a second one only for the queries whose best relevant
    candidate is not among their first ``k_max`` (else its place there is its rank).

    ``samples`` needs ``idx``, ``image_emb``, ``text_emb`` and parse features
    (``parse_features``).  Output: dir, qid, n, rank_true, rank_first_rel, top
    (K best (neg_sim, cid, rel), best first), ideal (K best relevances),
    pos_n, pos_sum, pos_max.  Without ``similarity`` only what follows from the
    relevances of all pairs: dir, qid, ideal, pos_n, pos_sum, pos_max."""
    directions = directions or [I2T]
    samples = materialise_samples(samples)
    n = samples.count()
    caption = F.struct("f_cap1", "f_cap2")
    several = bool(samples.groupBy("idx").agg((F.min(caption) != F.max(caption)).alias("several")).where("several").head(1))
    if not similarity and not several:
        rows = _relevance_rows(samples, k_max, weights).where("qid IS NOT NULL").checkpoint(eager=True)  # as a whole, like the rows below
        return rows.withColumn("dir", F.explode(F.array(*[F.lit(name) for name, *_ in directions]))).select("dir", *rows.columns)
    block_rows = block_rows or auto_block_rows(n, 2 * samples.sparkSession.sparkContext.defaultParallelism, BLOCK_ROWS)
    part = block_pairs(_side(samples, "qid", "image_emb"), _side(samples, "cid", "text_emb"),
                       _phase1_kernel(k_max, threshold, directions, weights, several), PHASE1_SCHEMA if several else RANK_SCHEMA,
                       block_rows=block_rows, q_rows=n, c_rows=n)
    of_relevance = [F.slice(F.sort_array(F.flatten(F.collect_list("ideal")), asc=False), 1, k_max).alias("ideal"),
                    F.sum("pos_n").alias("pos_n"), F.sum("pos_sum").alias("pos_sum"), F.max("pos_max").alias("pos_max")] if several else []
    merged = part.groupBy("dir", "qid").agg(
        F.sum("n").alias("n"),
        (F.sum("better_self") + 1).alias("rank_true"),
        F.max(F.when(F.col("best_cid").isNotNull(), F.struct("best_sim", (-F.col("best_cid")).alias("neg_cid")))).alias("_best"),
        F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k_max).alias("top"), *of_relevance,
    ).select("*", F.col("_best.best_sim").alias("best_sim"), (-F.col("_best.neg_cid")).alias("best_cid")).drop("_best")
    place = F.array_position(F.transform("top", lambda t: t["cid"]), F.col("best_cid"))
    if not several:
        merged = merged.join(_relevance_rows(samples, k_max, weights), "qid")
    merged = merged.withColumn("_place", F.nullif(place, F.lit(0))).checkpoint(eager=True)  # reused by pass 2 and the output
    beyond = merged.where(F.col("best_cid").isNotNull() & F.col("_place").isNull())
    left = {r["dir"]: r["count"] for r in beyond.groupBy("dir").count().collect()}
    counted = None
    for name, qv, cv in directions:
        if name not in left:
            continue
        vec = lambda v, key: samples.select(F.col("idx").alias(key), F.col(v).cast("array<double>").alias("vec"))
        q = beyond.where(F.col("dir") == name).select("qid", "best_sim", "best_cid").join(vec(qv, "qid"), "qid")
        above = block_pairs(q, vec(cv, "cid"), _phase2_kernel, PHASE2_SCHEMA, block_rows=block_rows, q_rows=left[name], c_rows=n)
        above = above.groupBy("qid").agg(F.sum("above_best").alias("above_best")).withColumn("dir", F.lit(name))
        counted = above if counted is None else counted.unionByName(above)
    if counted is None:
        merged = merged.withColumn("above_best", F.lit(None).cast("long"))
    else:
        merged = merged.join(counted, ["dir", "qid"], "left")
    merged = merged.withColumn("rank_first_rel", F.coalesce("_place", F.col("above_best") + 1)).drop("above_best", "best_sim", "best_cid", "_place")
    return merged if similarity else merged.select("dir", "qid", "ideal", "pos_n", "pos_sum", "pos_max")


RANK_ROWS = 1024
#: Rows of the ranking that a task gives at once (one query's at least).
RANKED = 1 << 20
PACKED_SCHEMA = "qid long, cid binary, similarity binary"
RANKING_SCHEMA = "qid long, rank long, cid long, similarity double"


def _packed_kernel(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
    sim = stack(qpdf["vec"]) @ stack(cpdf["vec"]).T
    return pd.DataFrame({"qid": qpdf["qid"], "cid": cpdf["cid"].to_numpy(np.int64).tobytes(), "similarity": [x.tobytes() for x in sim]})


def _ranked(table: pa.Table) -> pa.Table:
    """The rankings of some queries, from what they have of every block."""
    ids, first = np.unique(table.column("qid").to_numpy(), return_inverse=True)
    cids, sims = ([np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("cid", np.int64), ("similarity", np.float64)))
    out = []
    for i, q in enumerate(ids):
        at = np.flatnonzero(first == i)
        cid, sim = (np.concatenate([x[j] for j in at]) for x in (cids, sims))
        order = np.lexsort((cid, -np.round(sim, DECIMALS)))
        out.append(pa.table([np.full(len(cid), q), np.arange(1, len(cid) + 1), cid[order], sim[order]], ["qid", "rank", "cid", "similarity"]))
    return pa.concat_tables(out)


def full_ranking(samples: DataFrame, direction: tuple[str, str, str] = I2T, *, block_rows: int | None = None) -> DataFrame:
    """w01: (qid, rank, cid, similarity) of every candidate of every query, best first, equal ones by id.

    The result has n^2 rows by nature.  A task holds the products of two blocks of ``RANK_ROWS`` rows at most, which
    leave as one array a query, then ``RANKED`` rows of a few queries (or all candidates of one)."""
    _, qv, cv = direction
    ensure_checkpoint_dir(samples.sparkSession)
    samples = samples.select("idx", qv, cv).repartition("idx").checkpoint(eager=True)
    n = samples.count()
    block_rows = block_rows or auto_block_rows(n, 2 * samples.sparkSession.sparkContext.defaultParallelism, RANK_ROWS)
    side = lambda key, v: samples.select(F.col("idx").alias(key), F.col(v).cast("array<double>").alias("vec"))
    packed = block_pairs(side("qid", qv), side("cid", cv), _packed_kernel, PACKED_SCHEMA, block_rows=block_rows, q_rows=n, c_rows=n)
    some = F.pmod(F.xxhash64("qid", F.lit(19)), F.lit(n_blocks(n, max(1, RANKED // max(1, n)))))
    return packed.groupBy(some).applyInArrow(_ranked, RANKING_SCHEMA)


# --- per-query metrics ------------------------------------------------------
def _dcg(arr: Column, k: Column, value) -> Column:
    """sum_{r<k} value(arr[r]) / log2(r + 2)."""
    return F.aggregate(F.slice(F.transform(arr, lambda x, i: value(x) / F.log2(i + F.lit(2.0))), 1, k),
                       F.lit(0.0), lambda s, x: s + x)


def per_query_metrics(partials: DataFrame, k_values: list[int] | None = None, k_ndcg: list[int] | None = None) -> DataFrame:
    """hit@k (exact identity), reciprocal rank, nDCG@k per query."""
    k_values = k_values or DEFAULT_K
    k_ndcg = k_ndcg or [5, 10]
    cols = [F.col("dir"), F.col("qid")]
    for k in k_values:
        cols.append((F.col("rank_true") <= F.least(F.lit(k), F.col("n"))).cast("double").alias(f"hit_at_{k}"))
    cols.append(F.coalesce(F.lit(1.0) / F.col("rank_first_rel"), F.lit(0.0)).alias("rr"))
    for k in k_ndcg:
        kk = F.least(F.lit(k), F.col("n")).cast("int")
        dcg = _dcg(F.col("top"), kk, lambda x: x["rel"])
        idcg = _dcg(F.col("ideal"), kk, lambda x: x)
        cols.append(F.when(idcg > 0, dcg / idcg).otherwise(F.lit(0.0)).alias(f"ndcg_at_{k}"))
    return partials.select(*cols)


def graded_recall(partials: DataFrame, k_values: list[int] | None = None, threshold: float | None = None) -> DataFrame:
    """a15 with graded relevance: per direction, the share of queries with a relevant candidate
    among the first k.  Relevant is what has any relevance, or ``threshold`` of it at least.
    ``partials`` must hold the first max(k) candidates (``k_max``)."""
    relevant = (lambda x: x["rel"] > 0.0) if threshold is None else (lambda x: x["rel"] >= threshold)
    return partials.groupBy("dir").agg(*[
        F.avg(F.exists(F.slice("top", 1, k), relevant).cast("double")).alias(f"recall_at_{k}") for k in k_values or DEFAULT_K])


def retrieval_report(samples: DataFrame, *, k_values=None, threshold: float = 0.8, block_rows: int | None = None) -> DataFrame:
    """a18: Recall@k, MRR and nDCG@{5,10} for image->text and text->image and
    their means, as one row (``k_values`` honoured).  Both directions share
    the same products."""
    k_values = k_values or DEFAULT_K
    k_max = max(k_values + [5, 10])
    metric_names = [f"recall_at_{k}" for k in k_values] + ["mrr", "ndcg_at_5", "ndcg_at_10"]
    src = [f"hit_at_{k}" for k in k_values] + ["rr", "ndcg_at_5", "ndcg_at_10"]
    parts = ranked_partials(samples, [I2T, T2I], k_max=k_max, threshold=threshold, block_rows=block_rows)
    m = per_query_metrics(parts, k_values)
    aggs = [F.avg(F.when(F.col("dir") == d, F.col(sc))).alias(f"{d}_{nm}") for d in ("i2t", "t2i") for sc, nm in zip(src, metric_names)]
    both = m.agg(*aggs)
    return both.select("*", *[((F.col(f"i2t_{n}") + F.col(f"t2i_{n}")) / 2).alias(f"mean_{n}") for n in metric_names])
