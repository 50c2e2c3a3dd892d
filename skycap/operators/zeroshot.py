"""Distractor captions and zero-shot caption-to-image tests (j09, j10, a19, a20).

Samples stand in caption order, so those that share a query's caption are one
range of positions and all others its complement.  The complement is cut into
``k`` strata and a seeded hash draws one position in each: exactly ``k`` different
distractors for every query with at least ``k`` other-caption samples, whatever
caption dominates.  O(n * k) rows, equi-joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from skycap.functions import parse as P
from skycap.functions.scoring import DEFAULT_SCALE, dot, sigmoid_probability
from skycap.session import ensure_checkpoint_dir

HASH_PRIME = 2147483647


def draw_hash(q_idx: Column, t: Column, seed: int) -> Column:
    """Seeded hash of draw ``t`` of query ``q``: two Lehmer steps (multiplier
    48271 mod 2^31-1) over ``q*69621 + t + s``.  All intermediates stay below
    2^48 (bigint-safe in Spark and SQL)."""
    q = F.pmod(q_idx, F.lit(HASH_PRIME))
    h = (q * F.lit(69621) + t + F.lit(seed * 7919 + 11)) % F.lit(HASH_PRIME)
    for _ in range(2):
        h = (h * F.lit(48271)) % F.lit(HASH_PRIME)
    return h


def caption_order(samples: DataFrame) -> DataFrame:
    """(idx, caption, p): position of every sample by (caption, idx).  Range
    partitions hold consecutive positions; their sizes (one number per
    partition) give the offsets."""
    spark = samples.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (samples.select("idx", "caption").repartitionByRange(parts, "caption", "idx")
              .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the number of partitions
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy("caption", "idx")) - 1
    return placed.withColumn("_row", local).join(F.broadcast(offsets), "_part").select(
        "idx", "caption", (F.col("_off") + F.col("_row")).alias("p"))


def distractors(samples: DataFrame, k: int = 9, seed: int = 42) -> DataFrame:
    """j09: ``(q_idx, pos, c_idx)`` with pos 0 = the query itself and pos 1..k
    the distractors.  ``samples`` needs ``idx`` and ``caption``.

    Queries with fewer than ``k`` other-caption samples repeat those (in
    caption order) up to ``k``; queries with none are skipped, as in the original."""
    order = caption_order(samples)
    n = order.count()
    spans = order.groupBy("caption").agg(F.min("p").alias("lo"), F.count(F.lit(1)).alias("same"))
    q = order.join(spans, "caption").select(F.col("idx").alias("q_idx"), "lo", "same", (F.lit(n) - F.col("same")).alias("m")).where("m > 0")
    draws = q.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias("t"))
    m, t = F.col("m"), F.col("t")
    gap = F.greatest(F.floor(m / k), F.lit(1))
    spread = (draw_hash(F.col("q_idx"), F.lit(k).cast("long"), seed) % m + t * gap + draw_hash(F.col("q_idx"), t, seed) % gap) % m
    j = F.when(m >= k, spread).otherwise(t % m)
    p = F.when(j < F.col("lo"), j).otherwise(j + F.col("same"))
    drawn = draws.select("q_idx", (t + 1).cast("int").alias("pos"), p.cast("long").alias("p"))
    picked = drawn.join(order.select(F.col("idx").alias("c_idx"), "p"), "p").select("q_idx", "pos", "c_idx")
    return picked.unionByName(q.select("q_idx", F.lit(0).alias("pos"), F.col("q_idx").alias("c_idx")))


def zero_shot(samples: DataFrame, cand: DataFrame, scale: float = DEFAULT_SCALE) -> DataFrame:
    """j10: per query, probability of every candidate caption, the argmax
    (lowest position on ties), its confidence and the ordered probability list.

    ``cand`` is the output of ``distractors``; the candidate's text embedding
    is that of the sample owning the caption."""
    img = samples.select(F.col("idx").alias("q_idx"), F.col("image_emb").alias("img"),
                         F.col("caption").alias("correct_caption"))
    txt = samples.select(F.col("idx").alias("c_idx"), F.col("text_emb").alias("txt"), F.col("caption").alias("cand_caption"))
    scored = (cand.join(img, "q_idx").join(txt, "c_idx")
              .withColumn("probability", sigmoid_probability(dot("img", "txt"), scale)))
    best = F.max(F.struct(F.col("probability"), (-F.col("pos")).alias("neg_pos"), F.col("cand_caption")))
    out = scored.groupBy("q_idx").agg(
        best.alias("_b"),
        F.first("correct_caption").alias("correct_caption"),
        F.array_sort(F.collect_list(F.struct("pos", "probability"))).alias("_probs"),
    )
    return out.select(
        "q_idx", "correct_caption",
        (-F.col("_b.neg_pos")).alias("predicted_idx"),
        F.col("_b.cand_caption").alias("predicted_caption"),
        F.col("_b.probability").alias("confidence"),
        (F.col("_b.neg_pos") == 0).alias("is_correct"),
        F.transform("_probs", lambda x: x["probability"]).alias("all_probabilities"),
        P.extract_region(F.col("correct_caption")).alias("region"),
        P.extract_date(F.col("correct_caption")).alias("date"),
    )


def query_accuracy(results: DataFrame) -> DataFrame:
    """a19: total, correct, accuracy, mean confidence (0 when empty)."""
    return results.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if("is_correct").alias("correct_predictions"),
        F.coalesce(F.try_divide(F.count_if("is_correct"), F.count(F.lit(1))), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )


def accuracy_by_region_date(results: DataFrame) -> DataFrame:
    """a20: the same per parsed region and per parsed date (grouping sets)."""
    g = results.groupingSets([["region"], ["date"]], "region", "date").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_correct").alias("correct"),
        (F.count_if("is_correct") / F.count(F.lit(1))).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
        F.grouping_id().alias("_gid"),
    )
    return g.select(F.when(F.col("_gid") == 1, "region").otherwise("date").alias("breakdown"),
                    F.when(F.col("_gid") == 1, F.col("region")).otherwise(F.col("date")).alias("key"),
                    "total", "correct", "accuracy", "mean_confidence")
