"""Storm-event CSV (s08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.schemas import EVENT_CSV_SCHEMA


def write_storm_csv(raw: DataFrame, path: str) -> str:
    """Write storms in the source layout (header, ``MMM dd, yyyy`` dates),
    range-sorted by ``seq`` so part-file order is file order."""
    (raw.orderBy("seq").select("Hurricane", "Regions", "Start Date", "End Date")
     .write.mode("overwrite").option("header", True).csv(path))
    return path


def read_storm_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the storm CSV with a fixed schema.  ``seq`` is a struct that
    orders rows as they appear in the files (file name, split start, row
    position inside the split), so "first match in file order" stays exact
    after a parallel read, with no global window."""
    df = spark.read.option("header", True).schema(EVENT_CSV_SCHEMA).csv(path)
    seq = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row"))
    return df.withColumn("seq", seq)
