"""Exact quantiles of groups of any size by distributed selection (a03, a06).

``percentile`` keeps a value -> count map per group in one task, which for a
group that holds a whole field of distinct values grows with the data.  Here a
sketch of each group only proposes brackets, and counts decide:

1. one aggregate: row count and 1,001 approximate splitters per group;
2. every wanted rank gets two splitters around it, and one aggregate counts the
   values below and up to each; a rank that falls on a splitter is answered;
3. the values strictly between the two (some thousandths of the group) are
   written; up to ``small`` of them are sorted, more go through 1 and 2 again,
   as groups of their own.

All aggregates combine map-side, so a hot group costs each task a sketch and a
few counts.  Splitters are values of the group, so each round leaves fewer rows
whatever the distribution; ties end on a splitter.  A sketch that misses a rank
costs another round, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycap.session import ensure_checkpoint_dir

#: Intervals of a group's splitters, and the sketch's accuracy (rank error 1 / accuracy).
GRID = 1000
ACCURACY = 10 * GRID
#: Most values of one bracket that are sorted in one task.
SMALL = 50_000


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal; the keys of ``a`` stay."""
    other = b.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *[f"`{c}`" for c in b.columns if c not in keys])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return a.join(other, reduce(Column.__and__, on, F.lit(True)), how).drop(*[f"_k{i}" for i in range(len(keys))])


def _narrowed(values: DataFrame, wanted: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, targets: per group the wanted ranks with their bracket (lo, hi) and what the counts say of it."""
    grid = [i / GRID for i in range(GRID + 1)]
    sketch = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", grid, ACCURACY).alias("_s"))
    at = lambda t, n: F.floor(t["rank"] / n * GRID).cast("int")
    bracket = lambda t: F.struct(
        t["t"].alias("t"), t["rank"].alias("rank"),
        F.get("_s", F.greatest(at(t, F.col("_n")) - 1, F.lit(0))).alias("lo"),
        F.get("_s", F.least(at(t, F.col("_n")) + 2, F.lit(GRID))).alias("hi"))
    groups = _join(wanted, sketch, keys).select(*keys, F.transform("_targets", bracket).alias("_targets"))
    v = F.col("_v")
    counts = []
    for k in range(most):
        t = F.get("_targets", k)
        counts += [F.count_if(v < t["lo"]).alias(f"_a{k}"), F.count_if(v <= t["lo"]).alias(f"_b{k}"),
                   F.count_if(v < t["hi"]).alias(f"_c{k}"), F.count_if(v <= t["hi"]).alias(f"_d{k}")]
    counted = _join(values, groups, keys).groupBy(*keys).agg(F.first("_targets").alias("_targets"), *counts)
    out = []
    for k in range(most):
        t, a, b, c, d = F.get("_targets", k), *[F.col(f"_{x}{k}") for x in "abcd"]
        r = t["rank"]
        under, over = r < a, r >= d  # the sketch missed
        null = F.lit(None).cast("double")
        out.append(F.when(t.isNotNull(), F.struct(
            t["t"].alias("t"), r.alias("rank"),
            F.when(under, null).when(over, t["hi"]).otherwise(t["lo"]).alias("lo"),
            F.when(under, t["lo"]).when(over, null).otherwise(t["hi"]).alias("hi"),
            F.when(under, F.lit(0)).when(over, d).otherwise(b).alias("below"),
            F.when(under, a).when(over, F.lit(None)).otherwise(c - b).alias("inside"),
            F.when(under | over, null).when(r < b, t["lo"]).when(r >= c, t["hi"]).alias("value"))))
    return counted.select(*keys, F.filter(F.array(*out), lambda t: t.isNotNull()).alias("_targets"))


def _ranked(values: DataFrame, wanted: DataFrame, keys: list[str], most: int, small: int) -> list[DataFrame]:
    """Parts of (keys, t, value): the value of every wanted rank of every group."""
    state = _narrowed(values, wanted, keys, most).checkpoint(eager=True)
    flat = state.select(*keys, F.explode("_targets").alias("_x"))
    found = flat.where(F.col("_x.value").isNotNull()).select(*keys, F.col("_x.t").alias("t"), F.col("_x.value").alias("value"))
    left = flat.where(F.col("_x.value").isNull())
    if not left.head(1):
        return [found]
    open_ = state.select(*keys, F.filter("_targets", lambda t: t["value"].isNull()).alias("_targets")).where(F.size("_targets") > 0)
    v = F.col("_v")
    within = lambda t: (t["lo"].isNull() | (v > t["lo"])) & (t["hi"].isNull() | (v < t["hi"]))
    rows = (_join(values, open_, keys).select(*keys, "_v", F.explode(F.filter("_targets", within)).alias("_x"))
            .select(*keys, F.col("_x.t").alias("t"), (F.col("_x.rank") - F.col("_x.below")).alias("_r"),
                    (F.coalesce("_x.inside", F.lit(small + 1)) <= small).alias("_small"), "_v")).checkpoint(eager=True)
    sorted_ = (rows.where("_small").groupBy(*keys, "t").agg(F.first("_r").alias("_r"), F.sort_array(F.collect_list("_v")).alias("_vs"))
               .select(*keys, "t", F.get("_vs", F.col("_r").cast("int")).alias("value")))
    parts = [found, sorted_]
    large = rows.where(~F.col("_small"))
    if large.head(1):
        again = [*keys, "_t"]
        inner = large.select(*keys, F.col("t").alias("_t"), "_v", "_r")
        one = inner.groupBy(*again).agg(F.array(F.struct(F.lit(0).alias("t"), F.first("_r").alias("rank"))).alias("_targets"))
        for p in _ranked(inner.drop("_r"), one, again, 1, small):
            parts.append(p.select(*keys, F.col("_t").alias("t"), "value"))
    return parts


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "quantiles",
                    small: int = SMALL, written: bool = False) -> DataFrame:
    """keys and ``out``: array of the interpolated quantiles of the non-null values of each group, equal to
    ``percentile``.  A group without values has no row.  The rows are written once to the checkpoint folder,
    unless ``written`` says that they come from there; ``keys`` may be empty or null; NaN counts as the greatest value."""
    ensure_checkpoint_dir(df.sparkSession)
    own = [f"_g{i}" for i in range(len(keys))]
    if not keys:
        own, keys_in = ["_g0"], [F.lit(0).alias("_g0")]
    else:
        keys_in = [F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)]
    values = df.select(*keys_in, F.col(f"`{value}`").cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not written:
        values = values.checkpoint(eager=True)
    pos = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ranks = [f(x).cast("long") for x in pos for f in (F.floor, F.ceil)]
    sizes = values.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
    wanted = sizes.select(*own, F.array(*[F.struct(F.lit(i).alias("t"), r.alias("rank")) for i, r in enumerate(ranks)]).alias("_targets"))
    parts = _ranked(values, wanted, own, len(ranks), small)
    answers = reduce(DataFrame.unionByName, parts).groupBy(*own).agg(
        *[F.max(F.when(F.col("t") == i, F.col("value"))).alias(f"_q{i}") for i in range(len(ranks))])
    q = []
    for i, x in enumerate(pos):
        lo, hi = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        q.append(F.when(lo == hi, lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi))
    result = _join(answers, sizes, own)
    return result.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], F.array(*q).alias(out))


def median_deviation(df: DataFrame, keys: list[str], value: str, medians: DataFrame, median: str, out: str = "mad",
                     small: int = SMALL) -> DataFrame:
    """keys and ``out``: the median of |value - median| of each group, by the same selection."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[f"`{k}`" for k in keys], v.alias("_x"))
    centre = medians.select(*[f"`{k}`" for k in keys], F.col(f"`{median}`").alias("_m"))
    dev = _join(rows, centre, keys).select(*[f"`{k}`" for k in keys], F.abs(F.col("_x") - F.col("_m")).alias("_dev"))
    got = exact_quantiles(dev, keys, "_dev", [0.5], "_q", small)
    return got.select(*[f"`{k}`" for k in keys], F.get("_q", 0).alias(out))
