"""CSV / JSON sinks: epoch log (s13) and probe results (s14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.schemas import EPOCH_LOG_SCHEMA

PREDICTION_SCHEMA = "sample_info string, true_label long, predicted_probability double, predicted_label long"


def append_epoch_log(rows: DataFrame, path: str) -> str:
    """Append epoch rows; every appended part carries its own header line,
    which the reader skips, so the log reads back as one table."""
    (rows.select(F.col("epoch").cast("int"), "train_loss", "val_loss", "val_accuracy")
     .coalesce(1).write.mode("append").option("header", True).csv(path))
    return path


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(EPOCH_LOG_SCHEMA).csv(path)


def write_probe_results(predictions: DataFrame, metrics: DataFrame, roc: DataFrame, path: str) -> str:
    """Metrics as JSON, predictions and the ROC curve as CSV (keyed rows)."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    predictions.write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    roc.write.mode("overwrite").option("header", True).csv(f"{path}/roc")
    return path


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(PREDICTION_SCHEMA).csv(f"{path}/predictions")
