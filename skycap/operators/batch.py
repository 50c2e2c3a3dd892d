"""In-batch evaluation (j14, m06, a31, a32).

Samples are cut into batches of ``batch_size`` by their dense index; every
batch is one ``applyInPandas`` group of at most ``batch_size`` rows, so the
B x B logits exist only inside one task and no pair rows are emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.session import ship_package

from skycap.functions.scoring import DEFAULT_SCALE, np_contrastive_loss
from skycap.operators.pairs import stack

BATCH_SCHEMA = "batch_id long, scale double, size long, loss double, correct long"


def _batch_kernel(scales: list[float]):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        img, txt = stack(pdf["image_emb"]), stack(pdf["text_emb"])
        cos = img @ txt.T
        b = len(pdf)
        rows = []
        for s in scales:
            logits = s * cos
            preds = np.argmax(logits, axis=1)          # first max on ties
            rows.append((int(pdf["batch_id"].iloc[0]), float(s), b, np_contrastive_loss(logits),
                         int((preds == np.arange(b)).sum())))
        return pd.DataFrame(rows, columns=["batch_id", "scale", "size", "loss", "correct"])

    return kernel


def in_batch_scores(samples: DataFrame, batch_size: int = 32, scales: list[float] | None = None) -> DataFrame:
    """j14 + m06: per batch (and logit scale) the contrastive loss and the
    number of images whose best text is their own."""
    ship_package(samples.sparkSession)
    scales = scales or [DEFAULT_SCALE]
    b = samples.select("idx", "image_emb", "text_emb", F.floor(F.col("idx") / batch_size).cast("long").alias("batch_id"))
    return b.groupBy("batch_id").applyInPandas(_batch_kernel(scales), BATCH_SCHEMA)


def weighted_eval(batches: DataFrame) -> DataFrame:
    """a31: accuracy and loss weighted by batch size, per scale."""
    return batches.groupBy("scale").agg(
        (F.sum("correct") / F.sum("size")).alias("accuracy"),
        (F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("avg_loss"),
        F.sum("size").alias("samples"),
    )


def epoch_log(samples: DataFrame, epochs: int = 20, batch_size: int = 32) -> DataFrame:
    """An epoch log derived from the data: epoch ``e`` evaluates with logit
    scale ``e``; train loss is measured on even batches, validation on odd."""
    scales = [float(e) for e in range(1, epochs + 1)]
    per = in_batch_scores(samples, batch_size, scales).withColumn("is_val", F.col("batch_id") % 2 == 1)
    agg = per.groupBy("scale").agg(
        (F.sum(F.when(~F.col("is_val"), F.col("loss") * F.col("size"))) / F.sum(F.when(~F.col("is_val"), F.col("size")))).alias("train_loss"),
        (F.sum(F.when(F.col("is_val"), F.col("loss") * F.col("size"))) / F.sum(F.when(F.col("is_val"), F.col("size")))).alias("val_loss"),
        (F.sum(F.when(F.col("is_val"), F.col("correct"))) / F.sum(F.when(F.col("is_val"), F.col("size")))).alias("val_accuracy"),
    )
    return agg.select(F.col("scale").cast("int").alias("epoch"), "train_loss", "val_loss", "val_accuracy")


def best_epoch(log: DataFrame) -> DataFrame:
    """a32: epoch with the lowest validation loss, earliest on ties."""
    return log.agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
                   F.min("val_loss").alias("best_val_loss"))
