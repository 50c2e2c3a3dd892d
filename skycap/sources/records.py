"""Training-record JSONL readers and writers, image-path resolution, caption
files and the embedding store (s04-s07, s09-s12).

Readers take the raw lines (``spark.read.text``) so every rule is a column
expression and rejected lines come back in a second DataFrame with a reason,
instead of being logged and lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.functions import captions as C
from skycap.schemas import RECORD_KEYS, RECORD_SCHEMA

REQUIRED_KEYS = ["image_path", "caption", "sample_id", "variable", "model", "date"]
STRING_KEYS = ["image_path", "caption", "sample_id", "variable", "model", "date"]


def strip(c: Column) -> Column:
    """Python ``str.strip()`` (leading/trailing whitespace)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dirname(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0] if "/" in path.rstrip("/") else "."


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """File listing (``path``) without reading contents."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return df.select(F.regexp_replace("path", "^file:", "").alias("path"))


# s04 ----------------------------------------------------------------------
def read_records_strict(lines: DataFrame, listing: DataFrame, base_dir: str) -> tuple[DataFrame, DataFrame]:
    """Strict reader: exact key set (no missing, no extra), non-null string
    fields, whitespace stripped, image must exist.  Relative image paths are
    resolved against ``base_dir`` (the JSONL folder).

    Returns (records, rejects(line, reason))."""
    keys = F.json_object_keys("value")
    expected = F.array(*[F.lit(k) for k in sorted(RECORD_KEYS)])
    rec = F.from_json("value", RECORD_SCHEMA)
    df = lines.select("value", keys.alias("_keys"), rec.alias("r"))
    not_null = F.lit(True)
    for k in STRING_KEYS:
        not_null = not_null & F.col(f"r.{k}").isNotNull()
    not_null = not_null & F.col("r.metadata").isNotNull()
    reason = (F.when(F.col("_keys").isNull(), "malformed_json")
              .when(F.array_sort(F.col("_keys")) != expected, "missing_or_extra_fields")
              .when(~not_null, "null_field"))
    df = df.withColumn("reason", reason)
    ok = df.where(F.col("reason").isNull()).select(
        *[strip(F.col(f"r.{k}")).alias(k) for k in STRING_KEYS],
        F.struct(*[strip(F.col(f"r.metadata.{k}")).alias(k) for k in ("region", "domain", "generation_time")]).alias("metadata"),
        "value")
    resolved = F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(
        F.concat(F.lit(base_dir.rstrip("/") + "/"), F.col("image_path")))
    ok = ok.withColumn("resolved_image_path", resolved)
    files = listing.select(F.col("path").alias("resolved_image_path")).distinct()
    good = ok.join(files, "resolved_image_path", "left_semi")
    missing = ok.join(files, "resolved_image_path", "left_anti").select(F.col("value").alias("line"), F.lit("image_missing").alias("reason"))
    rejects = df.where(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason").unionByName(missing)
    return good.drop("value"), rejects


# s05 / s07 (training rule) --------------------------------------------------
def read_records_required(lines: DataFrame, listing: DataFrame, jsonl_dir: str, images_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lenient reader: the six required keys must be present (JSON null counts
    as present), extra keys allowed.  Image: relative path against the JSONL
    folder, else ``images_dir/<filename>``; dropped if neither exists.
    Adds image_filename, resolved_image_path, region (absent -> Unknown) and
    season (from the date)."""
    m = F.from_json("value", "map<string,string>")
    df = lines.select("value", m.alias("m"))
    present = F.lit(True)
    for k in REQUIRED_KEYS:
        present = present & F.map_contains_key("m", k)
    reason = F.when(F.col("m").isNull(), "malformed_json").when(~present, "missing_required_fields")
    df = df.withColumn("reason", reason)
    ok = df.where(F.col("reason").isNull())
    meta = F.from_json(F.col("m")["metadata"], "map<string,string>")
    region = F.when(meta.isNotNull() & F.map_contains_key(meta, "region"), meta["region"]).otherwise(F.lit("Unknown"))
    ok = ok.select("value", *[F.col("m")[k].alias(k) for k in REQUIRED_KEYS], region.alias("region"))
    ok = ok.withColumn("image_filename", basename(F.col("image_path")))
    primary = F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(
        F.concat(F.lit(jsonl_dir.rstrip("/") + "/"), F.col("image_path")))
    fallback = F.concat(F.lit(images_dir.rstrip("/") + "/"), F.col("image_filename"))
    ok = resolve_first_existing(ok, [primary, fallback], listing)
    good = ok.where(F.col("resolved_image_path").isNotNull()).withColumn("season", C.season_from_date(F.col("date")))
    missing = ok.where(F.col("resolved_image_path").isNull()).select(F.col("value").alias("line"), F.lit("image_missing").alias("reason"))
    rejects = df.where(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason").unionByName(missing)
    return good.drop("value"), rejects


def resolve_first_existing(df: DataFrame, candidates: list[Column], listing: DataFrame) -> DataFrame:
    """s07: df with ``resolved_image_path``, the first candidate path (in list order) that the listing holds, or null.
    Each candidate is one left join with the distinct paths: rows need no key of their own, and equal rows stay."""
    files = listing.select("path").distinct()
    names = [f"_found{i}" for i in range(len(candidates))]
    out = df.select("*", *[c.alias(f"_try{i}") for i, c in enumerate(candidates)])
    for i, name in enumerate(names):
        out = out.join(files.select(F.col("path").alias(name)), F.col(f"_try{i}") == F.col(name), "left")
    out = out.withColumn("resolved_image_path", F.coalesce(*names))
    return out.drop(*names, *[f"_try{i}" for i in range(len(candidates))])


def dataset_image_path(image_path: Column, base_path: str | None, jsonl_dir: str, listing: DataFrame | None = None) -> list[Column]:
    """s07 dataset-reader candidates: absolute as is; base path; JSONL folder;
    ``images/`` for bare file names; the original path as last resort."""
    cands = []
    is_abs = image_path.startswith("/")
    if base_path:
        cands.append(F.when(~is_abs, F.concat(F.lit(base_path.rstrip("/") + "/"), image_path)))
    cands.append(F.when(is_abs, image_path).otherwise(F.concat(F.lit(jsonl_dir.rstrip("/") + "/"), image_path)))
    cands.append(F.when(~image_path.contains("/"), F.concat(F.lit(jsonl_dir.rstrip("/") + "/images/"), image_path)))
    return cands


# s06 ----------------------------------------------------------------------
def read_records_failfast(spark: SparkSession, path: str) -> DataFrame:
    """Any malformed line fails the read."""
    return spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST").json(path)


# s10 ----------------------------------------------------------------------
def record_json(df: DataFrame) -> Column:
    """One JSON line per record, nulls written (not dropped)."""
    return F.to_json(F.struct(*[F.col(k) for k in RECORD_KEYS]), {"ignoreNullFields": "false"})


def write_records_jsonl(records: DataFrame, path: str) -> str:
    records.select(record_json(records).alias("value")).write.mode("overwrite").text(path)
    return path


def training_records(metadata: DataFrame, captions: DataFrame, generation_time: str) -> tuple[DataFrame, DataFrame]:
    """s10: metadata x caption files -> records; ``image_path = images/<stem>.png``;
    nested metadata {region, domain, generation_time}.  Missing caption file
    -> row skipped (returned in the second frame)."""
    m = metadata.select("*", F.explode("caption_files").alias("caption_file"))
    joined = m.join(captions, "caption_file", "left")
    have = joined.where(F.col("caption_text").isNotNull())
    stem = F.regexp_replace("caption_file", r"\.txt$", "")
    rec = have.select(
        F.concat(F.lit("images/"), stem, F.lit(".png")).alias("image_path"),
        strip(F.col("caption_text")).alias("caption"),
        "sample_id", "variable", "model", "date",
        F.struct(F.col("region"), F.col("domain"), F.lit(generation_time).alias("generation_time")).alias("metadata"))
    missing = joined.where(F.col("caption_text").isNull()).select("sample_id", "caption_file")
    return rec, missing


# s11 / s09 -----------------------------------------------------------------
def write_caption_files(samples: DataFrame, directory: str) -> str:
    """One text file per sample under ``<dir>/sample_id=<id>/``.  The samples are dealt to the cores, as a table of one
    row group is one task; tasks move their own files to their place, which the driver would do one by one."""
    cores = samples.sparkSession.sparkContext.defaultParallelism  # a number: files take time, not bytes, which AQE would go by
    (samples.select("sample_id", "caption").repartition(cores, "sample_id").write.mode("overwrite")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("sample_id").text(directory))
    return directory


def read_caption_files(spark: SparkSession, directory: str) -> DataFrame:
    """Whole-file read; the sample id comes from the folder name."""
    # the schema keeps ids as they are: inferred, 007 would become a number
    df = spark.read.schema("value string, sample_id string").option("wholetext", True).text(directory)
    return df.select(F.concat(F.col("sample_id"), F.lit(".txt")).alias("caption_file"),
                     F.col("value").alias("caption_text"))


# s12 ----------------------------------------------------------------------
def numeric_suffix(c: Column) -> Column:
    """``..._17`` -> 17, otherwise -1."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?:^|_)(\d+)$", 1), F.lit("")).try_cast("int"), F.lit(-1))


def save_embeddings(df: DataFrame, path: str, save_format: str = "parquet") -> str:
    if save_format not in ("parquet", "json"):
        raise ValueError(f"Unknown save format '{save_format}'; use parquet or json")
    getattr(df.write.mode("overwrite"), save_format)(path)
    return path


def load_embeddings(spark: SparkSession, path: str, load_format: str = "parquet") -> DataFrame:
    if load_format not in ("parquet", "json"):
        raise ValueError(f"Unknown load format '{load_format}'; use parquet or json")
    return getattr(spark.read, load_format)(path)
