"""Incremental captioning of newly arriving grid files.

The reference has no streaming; this is only a runner that applies the batch
operators (field statistics -> variable combination -> captions) to each
micro-batch of new grid files.  Fields are complete within one file, so each
micro-batch is self-contained.  Each micro-batch overwrites its own folder
(``epoch=<id>``), so a retried one leaves no duplicates; progress is kept in the
checkpoint folder that the caller names, so a restarted query resumes there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skycap.operators.grid import caption_samples
from skycap.schemas import GRID_SCHEMA


def caption_stream(spark: SparkSession, grid_dir: str, out_dir: str, *, checkpoint: str,
                   max_files_per_trigger: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Start the stream; ``available_now=True`` processes what is there and stops.
    ``max_files_per_trigger`` may be set where all variables of a field lie in one file."""
    reader = spark.readStream.schema(GRID_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(grid_dir)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        caption_samples(batch).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch_id}")

    writer = (src.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
