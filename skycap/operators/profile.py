"""Dataset profiles (a10-a13) as single grouping-sets aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long(df: DataFrame, dims: list[str]) -> DataFrame:
    """GROUPING SETS ((d1), (d2), ...) and the total, which an empty table has
    as well -> (dimension, key, count) rows."""
    g = df.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid"))
    full = (1 << len(dims)) - 1
    dim = F.lit("total")
    key = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = full - (1 << (len(dims) - 1 - i))
        dim = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim)
        key = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(key)
    total = df.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("key"), "count")
    return g.select(dim.alias("dimension"), key.alias("key"), F.col("count").cast("long")).unionByName(total)


def dataset_statistics(records: DataFrame) -> DataFrame:
    """a10: total and counts by variable and model; lexicographic date range
    on the total row."""
    counts = _long(records, ["variable", "model"])
    rng = records.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date")).withColumn("dimension", F.lit("total"))
    return counts.join(rng, "dimension", "left")


def weather_statistics(records: DataFrame) -> DataFrame:
    """a11: as a10 plus region and season; empty dates are ignored in the
    range, which defaults to 'unknown'."""
    counts = _long(records, ["variable", "model", "region", "season"])
    d = F.nullif(F.col("date"), F.lit(""))
    rng = records.agg(F.coalesce(F.min(d), F.lit("unknown")).alias("min_date"),
                      F.coalesce(F.max(d), F.lit("unknown")).alias("max_date")).withColumn("dimension", F.lit("total"))
    return counts.join(rng, "dimension", "left")


def generation_summary(metadata: DataFrame) -> DataFrame:
    """a12: total, by variable, model and region (NULL region -> full_domain)."""
    m = metadata.withColumn("region", F.coalesce(F.col("region"), F.lit("full_domain")))
    return _long(m, ["variable", "model", "region"])


def generation_stats(attempted: DataFrame, produced: DataFrame) -> DataFrame:
    """a13: attempted, successful, failed and success rate (0 when none)."""
    a = attempted.agg(F.count(F.lit(1)).alias("attempted"))
    s = produced.agg(F.count(F.lit(1)).alias("successful"))
    j = a.withColumn("_one", F.lit(1)).join(s.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return j.select("attempted", "successful", (F.col("attempted") - F.col("successful")).alias("failed"),
                    F.coalesce(F.try_divide(F.col("successful"), F.col("attempted")), F.lit(0.0)).alias("success_rate"))
