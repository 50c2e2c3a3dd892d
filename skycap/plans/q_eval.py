"""Registered queries: distractors, zero-shot tests and in-batch evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycap.functions.scoring import DEFAULT_SCALE
from skycap.operators import batch as B
from skycap.operators import zeroshot as Z
from skycap.plans import derive
from skycap.plans import sql_common as S
from skycap.plans.registry import query, rounded
from skycap.session import ensure_checkpoint_dir

K, SEED = 9, 42
SCALE = repr(DEFAULT_SCALE)

_DRAWS = S.EMB_PARSED + f""",
po AS (SELECT idx, caption, row_number() OVER (ORDER BY caption, idx) - 1 AS p, count(*) OVER () AS n FROM es),
sp AS (SELECT caption, min(p) AS lo, count(*) AS same FROM po GROUP BY caption),
dr AS (
  SELECT q.idx AS q_idx, t, lo, same, n - same AS m, greatest((n - same) // {K}, 1) AS gap,
         ((((q.idx * 69621 + t + {SEED * 7919 + 11}) % 2147483647) * 48271) % 2147483647 * 48271) % 2147483647 AS h,
         ((((q.idx * 69621 + {K} + {SEED * 7919 + 11}) % 2147483647) * 48271) % 2147483647 * 48271) % 2147483647 AS h0
  FROM po q JOIN sp USING (caption), range(0, {K}) r(t) WHERE n > same
),
dj AS (SELECT *, CASE WHEN m >= {K} THEN (h0 % m + t * gap + h % gap) % m ELSE t % m END AS j FROM dr),
pick AS (
  SELECT q_idx, t + 1 AS pos, c.idx AS c_idx FROM dj JOIN po c ON c.p = CASE WHEN j < lo THEN j ELSE j + same END
  UNION ALL SELECT DISTINCT q_idx, 0 AS pos, q_idx AS c_idx FROM dr
),
sc AS (
  SELECT p.q_idx, p.pos, p.c_idx, q.caption AS correct_caption, c.caption AS cand_caption,
         1.0 / (1.0 + exp(-({SCALE})::DOUBLE * list_dot_product(q.image_emb, c.text_emb))) AS probability
  FROM pick p JOIN es q ON q.idx = p.q_idx JOIN es c ON c.idx = p.c_idx
),
zs AS (
  SELECT q_idx, correct_caption, pos AS predicted_idx, cand_caption AS predicted_caption, probability AS confidence,
         pos = 0 AS is_correct, n_candidates, prob_sum,
         {S.region_parse('correct_caption')} AS region,
         COALESCE(NULLIF(regexp_extract(correct_caption, '(\\d{{1,2}} \\w{{3}} \\d{{4}})', 1), ''), 'Unknown') AS date
  FROM (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY probability DESC, pos) AS rk,
               count(*) OVER (PARTITION BY q_idx) AS n_candidates,
               sum(probability) OVER (PARTITION BY q_idx) AS prob_sum FROM sc) WHERE rk = 1
)"""


def _samples(spark, sf):
    """The sample table feeds several joins and counts: derive it once and
    read it back from the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return derive.emb_samples(spark, sf).select("idx", "caption", "image_emb", "text_emb").checkpoint(eager=True)


def _zero_shot(spark, sf):
    s = _samples(spark, sf)
    return Z.zero_shot(s, Z.distractors(s, K, SEED))


@query("j09_distractors", _DRAWS + "\nSELECT q_idx, CAST(pos AS BIGINT) AS pos, c_idx FROM pick")
def j09(spark, sf):
    return rounded(Z.distractors(_samples(spark, sf), K, SEED))


@query("j10_zero_shot", _DRAWS + f"""
SELECT q_idx, CAST(predicted_idx AS BIGINT) AS predicted_idx, predicted_caption, {S.R('confidence')} AS confidence,
       CAST(is_correct AS BIGINT) AS is_correct, n_candidates, {S.R('prob_sum')} AS prob_sum
FROM zs
""")
def j10(spark, sf):
    z = _zero_shot(spark, sf)
    return rounded(z.select("q_idx", "predicted_idx", "predicted_caption", "confidence",
                            F.col("is_correct").cast("long").alias("is_correct"),
                            F.size("all_probabilities").cast("long").alias("n_candidates"),
                            F.aggregate("all_probabilities", F.lit(0.0), lambda a, x: a + x).alias("prob_sum")))


@query("a19_query_accuracy", _DRAWS + f"""
SELECT count(*) AS total_queries, count(*) FILTER (WHERE is_correct) AS correct_predictions,
       {S.R('COALESCE(count(*) FILTER (WHERE is_correct) / NULLIF(count(*), 0), 0.0)')} AS accuracy,
       {S.R('COALESCE(avg(confidence), 0.0)')} AS mean_confidence
FROM zs
""")
def a19(spark, sf):
    return rounded(Z.query_accuracy(_zero_shot(spark, sf)))


@query("a20_accuracy_by_region_date", _DRAWS + f"""
SELECT 'region' AS breakdown, region AS key, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct,
       {S.R('count(*) FILTER (WHERE is_correct) / count(*)')} AS accuracy, {S.R('avg(confidence)')} AS mean_confidence
FROM zs GROUP BY region
UNION ALL
SELECT 'date', date, count(*), count(*) FILTER (WHERE is_correct),
       {S.R('count(*) FILTER (WHERE is_correct) / count(*)')}, {S.R('avg(confidence)')}
FROM zs GROUP BY date
""")
def a20(spark, sf):
    return rounded(Z.accuracy_by_region_date(_zero_shot(spark, sf)))


# in-batch evaluation ---------------------------------------------------------
def _batch_sql(scales_sql: str, bs: int = 32) -> str:
    return S.EMB + f""",
bt AS (SELECT *, idx // {bs} AS batch_id FROM es),
bp AS (
  SELECT a.batch_id, s.scale, a.idx AS i, b.idx AS j, s.scale * list_dot_product(a.image_emb, b.text_emb) AS z,
         count(*) OVER (PARTITION BY a.batch_id, s.scale, a.idx) AS bsz
  FROM bt a JOIN bt b ON a.batch_id = b.batch_id, ({scales_sql}) s(scale)
),
bl AS (
  SELECT batch_id, scale, max(bsz) AS size,
         avg(CASE WHEN i = j THEN (bsz - 1.0) * (greatest(-z, 0.0) + ln(1.0 + exp(-abs(z))))
                  ELSE greatest(z, 0.0) + ln(1.0 + exp(-abs(z))) END) AS loss
  FROM bp GROUP BY ALL
),
bc AS (
  SELECT batch_id, scale, count(*) FILTER (WHERE i = j) AS correct FROM (
    SELECT *, row_number() OVER (PARTITION BY batch_id, scale, i ORDER BY z DESC, j) AS rk FROM bp) WHERE rk = 1
  GROUP BY ALL
),
bb AS (SELECT bl.*, bc.correct FROM bl JOIN bc USING (batch_id, scale))"""


_ONE = _batch_sql(f"VALUES ({SCALE}::DOUBLE)")
_EPOCHS = _batch_sql("SELECT CAST(range AS DOUBLE) FROM range(1, 21)") + """,
lg AS (
  SELECT CAST(scale AS BIGINT) AS epoch,
    sum(loss * size) FILTER (WHERE batch_id % 2 = 0) / sum(size) FILTER (WHERE batch_id % 2 = 0) AS train_loss,
    sum(loss * size) FILTER (WHERE batch_id % 2 = 1) / sum(size) FILTER (WHERE batch_id % 2 = 1) AS val_loss,
    sum(correct) FILTER (WHERE batch_id % 2 = 1) / sum(size) FILTER (WHERE batch_id % 2 = 1) AS val_accuracy
  FROM bb GROUP BY scale
)"""


@query("j14_in_batch_pairs", _ONE + f"""
SELECT batch_id, size, correct FROM bb
""")
def j14(spark, sf):
    b = B.in_batch_scores(derive.emb_samples(spark, sf))
    return rounded(b.select("batch_id", "size", "correct"))


@query("m06_contrastive_loss", _ONE + f"""
SELECT batch_id, {S.R('loss')} AS loss FROM bb
""")
def m06(spark, sf):
    b = B.in_batch_scores(derive.emb_samples(spark, sf))
    return rounded(b.select("batch_id", "loss"))


@query("a31_weighted_eval", _ONE + f"""
SELECT {S.R('sum(correct) / sum(size)')} AS accuracy, {S.R('sum(loss * size) / sum(size)')} AS avg_loss,
       sum(size) AS samples FROM bb
""")
def a31(spark, sf):
    w = B.weighted_eval(B.in_batch_scores(derive.emb_samples(spark, sf)))
    return rounded(w.select("accuracy", "avg_loss", F.col("samples").cast("long")))


@query("a32_best_epoch", _EPOCHS + f"""
SELECT CAST(arg_min(epoch, (val_loss, epoch)) AS BIGINT) AS best_epoch, {S.R('min(val_loss)')} AS best_val_loss FROM lg
""")
def a32(spark, sf):
    log = B.epoch_log(derive.emb_samples(spark, sf))
    return rounded(B.best_epoch(log))
