"""Registered queries: JSONL readers, image-path resolution, caption files,
record writing, the embedding store and CSV sinks (s04-s07, s09-s14, j04,
j05, j13, p14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycap.operators import batch as B
from skycap.operators import probe as PR
from skycap.plans import derive
from skycap.plans import sql_common as S
from skycap.plans.q_eval import _EPOCHS
from skycap.plans.q_probe import LAB, _scored
from skycap.plans.registry import query, rounded
from skycap.schemas import RECORD_KEYS, RECORD_SCHEMA
from skycap.session import scratch_path
from skycap.sources import records as RC
from skycap.sources.sinks import append_epoch_log, read_epoch_log, read_predictions_csv, write_probe_results

RULES = S.EMB + """,
rl AS (
  SELECT es.*, idx % 17 = 3 AS bad_json, idx % 19 = 5 AS no_date, idx % 23 = 7 AS extra_key,
         idx % 29 = 11 AS null_date, idx % 13 = 6 AS no_region, idx % 9 = 8 AS bare, idx % 11 = 4 AS no_image,
         CASE WHEN month(CAST(date AS DATE)) IN (12, 1, 2) THEN 'winter' WHEN month(CAST(date AS DATE)) IN (3, 4, 5) THEN 'spring'
              WHEN month(CAST(date AS DATE)) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
  FROM es
)"""


def _jsonl(spark, sf):
    """Write the derived JSONL and the image listing; return paths + frames."""
    base = scratch_path(spark, "records")
    derive.record_lines(spark, sf).select("value").write.mode("overwrite").text(f"{base}/data.jsonl")
    lines = spark.read.text(f"{base}/data.jsonl")
    listing = derive.image_listing(spark, sf, base)
    return base, lines, listing


@query("s04_scan_jsonl_strict", RULES + """
SELECT sample_id, caption, date, model, 'temperature' AS variable, CASE WHEN no_region THEN NULL ELSE region END AS region
FROM rl WHERE NOT (bad_json OR no_date OR extra_key OR null_date OR bare OR no_image)
""")
def s04(spark, sf):
    base, lines, listing = _jsonl(spark, sf)
    good, _ = RC.read_records_strict(lines, listing, base)
    return good.select("sample_id", "caption", "date", "model", "variable", F.col("metadata.region").alias("region"))


@query("s05_scan_jsonl_required", RULES + """
SELECT sample_id, CASE WHEN no_region THEN 'Unknown' ELSE region END AS region,
       CASE WHEN null_date AND NOT no_date THEN 'unknown' ELSE season END AS season, sample_id || '.png' AS image_filename
FROM rl WHERE NOT (bad_json OR no_date OR no_image)
""")
def s05(spark, sf):
    base, lines, listing = _jsonl(spark, sf)
    good, _ = RC.read_records_required(lines, listing, base, f"{base}/images")
    return good.select("sample_id", "region", "season", "image_filename")


@query("s07_resolve_image_path", RULES + """
SELECT sample_id, CASE WHEN bare THEN 'images_dir' ELSE 'jsonl_dir' END AS resolved_via
FROM rl WHERE NOT (bad_json OR no_date OR no_image)
""")
def s07(spark, sf):
    base, lines, listing = _jsonl(spark, sf)
    good, _ = RC.read_records_required(lines, listing, base, f"{base}/images")
    via = F.when(F.col("resolved_image_path").startswith(f"{base}/images/") & ~F.col("image_path").startswith("images/"),
                 "images_dir").otherwise("jsonl_dir")
    return good.select("sample_id", via.alias("resolved_via"))


@query("s07b_dataset_image_path", RULES + """
SELECT sample_id, CASE WHEN no_image THEN 'as_given' WHEN bare THEN 'images_dir' ELSE 'jsonl_dir' END AS resolved_via
FROM rl WHERE NOT bad_json
""")
def s07b(spark, sf):
    """The dataset reader's rule: first existing candidate, else the path as it is."""
    base, _, listing = _jsonl(spark, sf)
    rec = spark.read.schema(RECORD_SCHEMA).json(f"{base}/data.jsonl").where(F.col("sample_id").isNotNull())
    hit = RC.resolve_first_existing(rec, RC.dataset_image_path(F.col("image_path"), None, base), listing)
    via = (F.when(F.col("resolved_image_path").isNull(), "as_given")
           .when(F.col("image_path").contains("/"), "jsonl_dir").otherwise("images_dir"))
    return hit.select("sample_id", via.alias("resolved_via"))


@query("j05_image_exists", RULES + """
SELECT sample_id, NOT no_image AS has_image FROM rl WHERE NOT (bad_json OR no_date)
""")
def j05(spark, sf):
    base, lines, listing = _jsonl(spark, sf)
    good, rejects = RC.read_records_required(lines, listing, base, f"{base}/images")
    miss = rejects.where(F.col("reason") == "image_missing").select(
        F.get_json_object("line", "$.sample_id").alias("sample_id"), F.lit(False).alias("has_image"))
    return good.select("sample_id", F.lit(True).alias("has_image")).unionByName(miss)


@query("s06_scan_jsonl_failfast", RULES + """
SELECT sample_id, CASE WHEN null_date THEN NULL ELSE date END AS date, model FROM rl WHERE NOT (bad_json OR no_date OR extra_key)
""")
def s06(spark, sf):
    path = scratch_path(spark, "failfast")
    lines = derive.record_lines(spark, sf)
    # keep the lines whose content is a JSON object with exactly the record keys
    keys = F.array_sort(F.json_object_keys("value"))
    expected = F.array(*[F.lit(k) for k in sorted(RECORD_KEYS)])
    lines.where(keys == expected).select("value").write.mode("overwrite").text(path)
    return RC.read_records_failfast(spark, path).select("sample_id", "date", "model")


# caption files / training records ------------------------------------------
def _caption_dir(spark, sf, only=None):
    d = scratch_path(spark, "captions")
    s = derive.emb_samples(spark, sf)
    RC.write_caption_files(s if only is None else s.where(only), d)
    return d


@query("s11_write_captions", S.EMB + "\nSELECT sample_id || '.txt' AS caption_file FROM es")
def s11(spark, sf):
    d = _caption_dir(spark, sf)
    files = RC.list_files(spark, d)
    return files.select(F.concat(F.regexp_extract("path", r"sample_id=([^/]+)/", 1), F.lit(".txt")).alias("caption_file"))


@query("s09_scan_caption_files", S.EMB + "\nSELECT sample_id || '.txt' AS caption_file, caption AS caption_text FROM es")
def s09(spark, sf):
    return RC.read_caption_files(spark, _caption_dir(spark, sf))


def _metadata(spark, sf):
    s = derive.emb_samples(spark, sf)
    return s.select("sample_id", F.lit("temperature").alias("variable"), "model", "date", "region",
                    F.when(F.col("model") == "hrrrak", "alaska").otherwise("conus").alias("domain"),
                    F.array(F.concat("sample_id", F.lit(".txt"))).alias("caption_files"))


@query("j04_caption_file", S.EMB + "\nSELECT sample_id, idx % 10 <> 9 AS has_caption FROM es")
def j04(spark, sf):
    caps = RC.read_caption_files(spark, _caption_dir(spark, sf, F.col("idx") % 10 != 9))
    rec, missing = RC.training_records(_metadata(spark, sf), caps, derive.GENERATION_TIME)
    return rec.select("sample_id", F.lit(True).alias("has_caption")).unionByName(
        missing.select("sample_id", F.lit(False).alias("has_caption")))


@query("s10_write_training_jsonl", S.EMB + f"""
SELECT 'images/' || sample_id || '.png' AS image_path, caption, sample_id, region,
       CASE WHEN model = 'hrrrak' THEN 'alaska' ELSE 'conus' END AS domain, '{derive.GENERATION_TIME}' AS generation_time
FROM es
""")
def s10(spark, sf):
    caps = RC.read_caption_files(spark, _caption_dir(spark, sf))
    rec, _ = RC.training_records(_metadata(spark, sf), caps, derive.GENERATION_TIME)
    path = scratch_path(spark, "train-jsonl")
    RC.write_records_jsonl(rec, path)
    back = RC.read_records_failfast(spark, path)
    return back.select("image_path", "caption", "sample_id", F.col("metadata.region").alias("region"),
                       F.col("metadata.domain").alias("domain"), F.col("metadata.generation_time").alias("generation_time"))


# embedding store -----------------------------------------------------------
@query("s12_embedding_store", S.EMB + """
SELECT sample_id, COALESCE(TRY_CAST(NULLIF(regexp_extract(sample_id, '(?:^|_)(\\d+)$', 1), '') AS INTEGER), -1) AS numeric_id,
       CAST(len(image_emb) AS BIGINT) AS image_dim, CAST(len(text_emb) AS BIGINT) AS text_dim
FROM es
""")
def s12(spark, sf):
    path = scratch_path(spark, "emb-store")
    RC.save_embeddings(derive.emb_samples(spark, sf).select("sample_id", "image_emb", "text_emb", "caption"), path)
    e = RC.load_embeddings(spark, path)
    return rounded(e.select("sample_id", RC.numeric_suffix(F.col("sample_id")).alias("numeric_id"),
                            F.size("image_emb").alias("image_dim"), F.size("text_emb").alias("text_dim")))


# j13 / p14: embedding rows <-> dataset records ------------------------------
@query("j13_sample_lookup", RULES + """
SELECT e.sample_id, r.sample_id IS NOT NULL AS found
FROM es e LEFT JOIN (SELECT sample_id FROM rl WHERE NOT (bad_json OR no_date OR no_image)) r USING (sample_id)
""")
def j13(spark, sf):
    base, lines, listing = _jsonl(spark, sf)
    good, _ = RC.read_records_required(lines, listing, base, f"{base}/images")
    emb = derive.emb_samples(spark, sf).select("sample_id")
    return emb.join(good.select("sample_id", F.lit(True).alias("found")), "sample_id", "left").select(
        "sample_id", F.coalesce("found", F.lit(False)).alias("found"))


@query("p14_assemble_metadata", RULES + f""",
ok AS (SELECT * FROM rl WHERE NOT (bad_json OR no_date OR no_image))
SELECT e.idx, COALESCE(ok.sample_id, 'unknown_' || CAST(e.idx AS VARCHAR)) AS sample_id,
       CASE WHEN ok.sample_id IS NULL THEN 'Unknown' WHEN ok.null_date THEN NULL ELSE ok.date END AS date,
       COALESCE(CASE WHEN ok.sample_id IS NOT NULL THEN 'temperature' END, 'temperature') AS variable,
       COALESCE(ok.model, 'hrrr') AS model,
       CASE WHEN ok.sample_id IS NOT NULL THEN (CASE WHEN ok.no_region THEN 'Unknown' ELSE ok.region END)
            ELSE {S.region_parse('e.caption')} END AS region
FROM es e LEFT JOIN ok USING (sample_id)
""")
def p14(spark, sf):
    from skycap.functions import parse as P

    base, lines, listing = _jsonl(spark, sf)
    good, _ = RC.read_records_required(lines, listing, base, f"{base}/images")
    emb = derive.emb_samples(spark, sf).select("idx", "sample_id", "caption")
    j = emb.join(good.select("sample_id", "date", "variable", "model", F.col("region").alias("rec_region"),
                             F.lit(True).alias("_found")), "sample_id", "left")
    found = F.col("_found").isNotNull()
    return rounded(j.select(
        "idx",
        F.when(found, F.col("sample_id")).otherwise(F.concat(F.lit("unknown_"), F.col("idx").cast("string"))).alias("sample_id"),
        F.when(found, F.col("date")).otherwise(F.lit("Unknown")).alias("date"),
        F.coalesce("variable", F.lit("temperature")).alias("variable"),
        F.coalesce("model", F.lit("hrrr")).alias("model"),
        F.when(found, F.col("rec_region")).otherwise(P.extract_region(F.col("caption"))).alias("region")))


# sinks -----------------------------------------------------------------------
@query("s13_epoch_log_append", _EPOCHS + f"""
SELECT CAST(epoch AS BIGINT) AS epoch, {S.R('train_loss')} AS train_loss, {S.R('val_loss')} AS val_loss,
       {S.R('val_accuracy')} AS val_accuracy FROM lg
""")
def s13(spark, sf):
    log = B.epoch_log(derive.emb_samples(spark, sf))
    path = scratch_path(spark, "epoch-log")
    append_epoch_log(log.where(F.col("epoch") <= 10), path)
    append_epoch_log(log.where(F.col("epoch") > 10), path)
    return rounded(read_epoch_log(spark, path))


@query("s14_write_probe_results", LAB + f"""
SELECT date || '_' || region || '_' || COALESCE(storm, 'no_hurricane') AS sample_info, CAST(label AS BIGINT) AS true_label,
       {S.R('score')} AS predicted_probability, CAST(pred AS BIGINT) AS predicted_label
FROM pr
""")
def s14(spark, sf):
    sc = PR.feature_vector(_scored(spark, sf), use_embeddings=False)
    pred = sc.select("sample_info", F.col("label").alias("true_label"), F.col("score").alias("predicted_probability"),
                     F.col("pred").alias("predicted_label"))
    path = scratch_path(spark, "probe-results")
    write_probe_results(pred, PR.classification_metrics(sc, "label", "pred"), PR.roc_curve(sc, "label", "score"), path)
    return rounded(read_predictions_csv(spark, path))
