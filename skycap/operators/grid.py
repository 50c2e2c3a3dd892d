"""Grid operators: unit conversion, longitude wrap, region range join, field
statistics, variable combination and caption rendering (p01-p04, j01-j03,
a01-a09, c10).

Scale notes
-----------
* One scan serves every region: cells are tagged with all overlapping region
  boxes by a broadcast range join (the box table is fixed at 10 rows), plus a
  whole-field tag.  The reference re-reads the field once per region.
* Statistics are one ``groupBy`` with partial (map-side) aggregation, so a hot
  group (the whole-domain tag holds every cell) is combined per task before
  the shuffle.  Exact percentiles keep a value->count map per group, whose size
  is the number of *distinct* values, not rows; ``percentiles="approx"``
  switches to ``percentile_approx`` for high-cardinality continuous fields;
  ``percentiles="selection"`` stays exact and bounded (``quantiles.py``).
* MAD needs the median first.  The median table (one row per group) is joined
  back with a plain join: AQE turns it into a broadcast only when its measured
  size is small, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycap.functions import captions as C
from skycap.operators.quantiles import exact_quantiles, median_deviation
from skycap.schemas import (
    ADDITIONAL_VARIABLES,
    CONUS,
    FIELD_KEYS,
    PRIMARY_VARIABLE,
    REGION_MODEL_PAIRS,
    REGIONS,
    region_dim,
    variable_dim,
)
from skycap.session import ensure_checkpoint_dir
from skycap.sources.grid import requested_forecast_hour

WHOLE_FIELD = "__field__"
GROUP_KEYS = FIELD_KEYS + ["region"]
PERCENTILES = [0.5, 0.25, 0.75, 0.9, 0.95]


# p01 ----------------------------------------------------------------------
def convert_units(cells: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """``value = (raw + offset) * factor`` with each step only when set; also
    attaches unit and description (broadcast join on the 4-row variable table)."""
    spark = spark or cells.sparkSession
    vd = F.broadcast(variable_dim(spark).select("variable", "unit", "description",
                                                "conversion_factor", "conversion_offset"))
    out = cells.join(vd, "variable", "left")
    value = (F.col("raw_value") + F.coalesce("conversion_offset", F.lit(0.0))) * F.coalesce("conversion_factor", F.lit(1.0))
    return out.withColumn("value", value).drop("conversion_factor", "conversion_offset")


# p02 ----------------------------------------------------------------------
def wrap_longitude(cells: DataFrame) -> DataFrame:
    """Longitudes above 180 are shifted to -180..180 (non-Alaska models).

    For the Alaska model the original keeps 0-360 data and shifts negative
    box bounds instead; normalising the data once is equivalent for boxes in
    -180..-130 apart from cells at exactly 180."""
    return cells.withColumn("lon", F.when(F.col("lon") > 180.0, F.col("lon") - 360.0).otherwise(F.col("lon")))


# p04 ----------------------------------------------------------------------
def region_display_name(region: Column, default_region: Column) -> Column:
    r = F.coalesce(region, default_region)
    return F.when(r.isin("Alaska", CONUS), r).otherwise(F.concat(F.lit("US "), r, F.lit(" region")))


# j01 ----------------------------------------------------------------------
def request_work_list(dates: DataFrame, spark: SparkSession | None = None, regions: list[str] | None = None) -> DataFrame:
    """Dates x (region, model) pairs.  The pair list is a fixed constant, so
    each date row is expanded with ``explode`` of a literal array: no join."""
    pairs = [(i, r, m) for i, (r, m) in enumerate(REGION_MODEL_PAIRS) if regions is None or r in regions]  # p07
    lit_pairs = F.array(*[F.struct(F.lit(i).alias("pair_seq"), F.lit(r).alias("region"), F.lit(m).alias("model"))
                          for i, r, m in pairs])
    return dates.select("*", F.explode(lit_pairs).alias("_p")).select("*", "_p.*").drop("_p")


# j02 / p03 ----------------------------------------------------------------
def region_tags(lon: Column, lat: Column) -> Column:
    """Whole-field tag plus the name of every region box containing
    (lon, lat) (inclusive on all four sides), NULL for the others.  The box
    table is a fixed 10-entry constant, so the range join becomes plain
    comparisons in the scan's projection (whole-stage codegen, one pass, no
    join, no shuffle)."""
    tags = [F.lit(WHOLE_FIELD)]
    for n, a, b, c, d, _ in REGIONS:
        tags.append(F.when(lon.between(a, b) & lat.between(c, d), F.lit(n)))
    return F.array(*tags)


def tag_regions(cells: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """One row per (cell, tag): the whole-field tag and every box containing
    the cell.  Output: cell columns + ``region``."""
    return cells.withColumn("region", F.explode(region_tags(F.col("lon"), F.col("lat")))).where(F.col("region").isNotNull())


def tag_regions_join(cells: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Same result as ``tag_regions`` through a broadcast range join, for box
    tables that are data rather than constants (hundreds of boxes)."""
    spark = spark or cells.sparkSession
    boxes = F.broadcast(region_dim(spark).select("name", "lon0", "lon1", "lat0", "lat1"))
    in_box = (cells.join(boxes, F.col("lon").between(F.col("lon0"), F.col("lon1"))
                         & F.col("lat").between(F.col("lat0"), F.col("lat1")))
              .withColumn("region", F.col("name")).drop("name", "lon0", "lon1", "lat0", "lat1"))
    return cells.withColumn("region", F.lit(WHOLE_FIELD)).unionByName(in_box)


# a01-a08 ------------------------------------------------------------------
def _stat_aggs(value: str, percentiles: str) -> list[Column]:
    v = F.col(value)
    if percentiles == "approx":
        pct = F.percentile_approx(v, PERCENTILES, 10000)
    else:
        pct = F.percentile(v, F.array(*[F.lit(p) for p in PERCENTILES]))
    return [
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.var_pop(v).alias("var"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
        pct.alias("_pct"),
        F.count(v).alias("count_valid"),
        F.count(F.lit(1)).alias("cells"),
    ]


def grouped_statistics(tagged: DataFrame, keys: list[str], value: str = "value", percentiles: str = "exact",
                       with_mad: bool = True) -> DataFrame:
    """All field statistics per group (a01-a08).

    Pass 1 aggregates moments, percentiles and counts per group.  MAD needs
    the median, so pass 2 joins the per-group table (one row per group; AQE
    broadcasts it when small) back to the cells and aggregates
    ``median(|x - median|)`` while carrying the pass-1 columns through with
    ``max`` (constant per group, combined map-side).  The per-group table is
    consumed once, so the plan scans the cells twice and never recomputes it."""
    if percentiles == "selection":
        return _derived(_selected_statistics(tagged, keys, value, with_mad))
    stats = tagged.groupBy(*keys).agg(*_stat_aggs(value, percentiles))
    stats = stats.select(
        *keys, "min", "max", "mean", "std", "var", "skewness", "kurtosis", "count_valid", "cells",
        F.get("_pct", 0).alias("median"), F.get("_pct", 1).alias("percentile_25"),
        F.get("_pct", 2).alias("percentile_75"), F.get("_pct", 3).alias("percentile_90"),
        F.get("_pct", 4).alias("percentile_95"),
    )
    if not with_mad:  # one aggregate over one scan; Catalyst prunes what the caller leaves unused
        return _derived(stats.withColumn("mad", F.lit(None).cast("double")))
    carried = [c for c in stats.columns if c not in keys]
    dev = F.abs(F.col(value) - F.col("median"))
    mad_agg = F.percentile_approx(dev, 0.5, 10000) if percentiles == "approx" else F.median(dev)
    out = (tagged.select(*keys, value).join(stats, keys)
           .groupBy(*keys).agg(mad_agg.alias("mad"), *[F.max(c).alias(c) for c in carried]))
    return _derived(out)


def _derived(stats: DataFrame) -> DataFrame:
    return (stats.withColumn("range", F.col("max") - F.col("min"))
            .withColumn("iqr", F.col("percentile_75") - F.col("percentile_25"))
            .withColumn("coeff_variation",
                        F.when(F.col("mean") != 0, F.col("std") / F.abs(F.col("mean"))).otherwise(F.lit(0.0))))


def _selected_statistics(tagged: DataFrame, keys: list[str], value: str, with_mad: bool) -> DataFrame:
    """The same table with quantiles by distributed selection: no group's values
    meet in one task.  The tagged values are written once and read from there."""
    ensure_checkpoint_dir(tagged.sparkSession)
    rows = tagged.select(*keys, value).checkpoint(eager=True)
    moments = rows.groupBy(*keys).agg(*[a for i, a in enumerate(_stat_aggs(value, "approx")) if i != 7])
    names = ("median", "percentile_25", "percentile_75", "percentile_90", "percentile_95")
    q = exact_quantiles(rows, keys, value, PERCENTILES, "_pct", written=True).select(*keys, *[F.get("_pct", i).alias(n) for i, n in enumerate(names)])
    q = q.checkpoint(eager=True)
    out = moments.join(q, keys, "left")
    if not with_mad:
        return out.withColumn("mad", F.lit(None).cast("double"))
    return out.join(median_deviation(rows, keys, value, q, "median"), keys, "left")


STAT_COLUMNS = ["min", "max", "mean", "std", "median", "range", "var", "skewness", "kurtosis",
                "percentile_25", "percentile_75", "percentile_90", "percentile_95", "iqr", "mad",
                "coeff_variation"]


# a09 ----------------------------------------------------------------------
def _pair_regions(model: Column) -> Column:
    """Regions paired with the model (fixed constant list)."""
    by_model: dict[str, list[str]] = {}
    for r, m in REGION_MODEL_PAIRS:
        by_model.setdefault(m, []).append(r)
    expr = F.array().cast("array<string>")
    for m, regs in by_model.items():
        expr = F.when(model == m, F.array(*[F.lit(r) for r in regs])).otherwise(expr)
    return expr


def field_statistics(grid: DataFrame, spark: SparkSession | None = None, percentiles: str = "exact",
                     with_mad: bool = True) -> DataFrame:
    """Statistics of every field for every (region, model) pair of its model.

    ``Continental US`` is the whole field; other regions mask by their box.
    Masked-out cells count as missing, so ``count_valid + count_missing`` is
    the field's cell count.  Regions with no cells keep a row with NULL
    statistics and ``count_valid = 0``.

    Plan: one grouped aggregate (plus the MAD pass); the per-group table is
    consumed once: a window over each field's few group rows supplies the
    field's cell count and present regions, and one ``explode`` maps the
    whole-field row to ``Continental US`` and to the empty paired regions.
    GRIB name and domain are constant per field and ride along as grouping
    keys (no string aggregation)."""
    spark = spark or grid.sparkSession
    cells = wrap_longitude(grid)
    vd = variable_dim(spark)
    conv = F.broadcast(vd.select("variable", "conversion_factor", "conversion_offset"))
    value = (F.col("raw_value") + F.coalesce("conversion_offset", F.lit(0.0))) * F.coalesce("conversion_factor", F.lit(1.0))
    # NULL-free keys so the MAD pass can equi-join on them
    cells = cells.join(conv, "variable", "left").select(
        *FIELD_KEYS, F.coalesce("grib_name", F.lit("Unknown")).alias("grib_name"),
        F.coalesce("domain", F.lit("")).alias("domain"), "lat", "lon", value.alias("value"))
    fkeys = FIELD_KEYS + ["grib_name", "domain"]
    stats = grouped_statistics(tag_regions(cells), fkeys + ["region"], "value", percentiles, with_mad)

    w = Window.partitionBy(*fkeys)
    is_whole = F.col("region") == WHOLE_FIELD
    ws = stats.select("*", F.max(F.when(is_whole, F.col("cells"))).over(w).alias("total_cells"),
                      F.collect_set(F.when(~is_whole, F.col("region"))).over(w).alias("_present"))
    paired = _pair_regions(F.col("model"))
    empty = F.array_except(F.filter(paired, lambda r: r != CONUS), F.col("_present"))
    whole_out = F.concat(F.when(F.array_contains(paired, CONUS), F.array(F.struct(F.lit(CONUS).alias("r"), F.lit(True).alias("s"))))
                         .otherwise(F.array().cast("array<struct<r:string,s:boolean>>")),
                         F.transform(empty, lambda r: F.struct(r.alias("r"), F.lit(False).alias("s"))))
    box_out = F.when(F.array_contains(paired, F.col("region")),
                     F.array(F.struct(F.col("region").alias("r"), F.lit(True).alias("s")))).otherwise(
        F.array().cast("array<struct<r:string,s:boolean>>"))
    out = ws.select("*", F.explode(F.when(is_whole, whole_out).otherwise(box_out)).alias("_o"))
    keep = F.col("_o.s")
    out = out.join(F.broadcast(vd.select("variable", "unit", "description")), "variable", "left")
    return out.select(
        *FIELD_KEYS, F.col("_o.r").alias("region"),
        *[F.when(keep, F.col(c)).alias(c) for c in STAT_COLUMNS],
        F.when(keep, F.col("count_valid")).otherwise(F.lit(0)).cast("long").alias("count_valid"),
        (F.col("total_cells") - F.when(keep, F.col("count_valid")).otherwise(F.lit(0))).cast("long").alias("count_missing"),
        "unit", "description",
        C.valid_time_string(F.col("valid_time")).alias("valid_time_str"),
        F.upper("model").alias("model_upper"),
        "grib_name",
        F.nullif(F.col("domain"), F.lit("")).alias("domain"),
    )


# j03 ----------------------------------------------------------------------
def _var_struct(name: str) -> Column:
    return F.max(F.when(F.col("variable") == name,
                        F.struct("mean", "min", "max", "unit", "count_valid"))).alias(name)


def combine_variables(stats: DataFrame, forecast_hour: int = 0) -> DataFrame:
    """Attach the additional variables to the primary one for each
    (model, valid time, region).  Conditional aggregation: one shuffle, no
    self-joins.  A missing additional variable is skipped; a missing (or
    empty) primary drops the sample."""
    fxx = requested_forecast_hour(F.col("variable"), F.lit(forecast_hour))
    wanted = stats.where(F.col("forecast_hour") == fxx).where(F.col("count_valid") > 0)
    out = wanted.groupBy("model", "valid_time", "region").agg(
        _var_struct(PRIMARY_VARIABLE), *[_var_struct(v) for v in ADDITIONAL_VARIABLES],
        F.max(F.when(F.col("variable") == PRIMARY_VARIABLE, F.col("domain"))).alias("domain"),
    )
    return out.where(F.col(PRIMARY_VARIABLE).isNotNull())


# c10 ----------------------------------------------------------------------
def caption_column(detailed: bool = False, legacy_season: bool = False) -> Column:
    t = F.col(PRIMARY_VARIABLE)
    vt = C.valid_time_string(F.col("valid_time"))
    season = C.season_descriptor(vt, ts=F.col("valid_time"), legacy=legacy_season)
    op = C.opening(F.col("region"), season, C.format_date(vt))
    temp = C.describe_temperature(t["mean"], t["min"], t["max"], t["unit"], detailed=detailed)
    extras = []
    for v in ADDITIONAL_VARIABLES:
        s = F.col(v)
        extras.append(F.when(s.isNotNull(), C.describe_variable(F.lit(v), s["mean"], s["min"], s["max"], s["unit"],
                                                                detailed=detailed)))
    return C.generate_caption(op, temp, *extras)


# p08 ----------------------------------------------------------------------
def sample_id_column(date_col: Column, variable: str, model: Column, region: Column) -> Column:
    suffix = F.coalesce(F.replace(F.lower(region), F.lit(" "), F.lit("_")), F.lit("conus"))
    return F.concat_ws("_", date_col, F.lit(variable), model, suffix)


def caption_samples(grid: DataFrame, forecast_hour: int = 0, *, detailed: bool = False,
                    legacy_season: bool = False, percentiles: str = "exact") -> DataFrame:
    """Flagship: caption every (model, valid time, region) from raw cells.

    scan -> convert -> wrap -> range join -> grouped statistics ->
    combine variables -> render, as one lazy plan."""
    # captions use mean/min/max/counts only: skip the MAD pass, prune the rest
    stats = field_statistics(grid, percentiles=percentiles, with_mad=False)
    combined = combine_variables(stats, forecast_hour)
    date = F.date_format("valid_time", "yyyy-MM-dd")
    return combined.select(
        sample_id_column(date, PRIMARY_VARIABLE, F.col("model"), F.col("region")).alias("sample_id"),
        date.alias("date"), "model", "region", "domain",
        caption_column(detailed=detailed, legacy_season=legacy_season).alias("caption"),
    )
