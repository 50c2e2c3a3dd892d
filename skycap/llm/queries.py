"""Queries of the corpus operators: thin digests of each operator's results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.llm import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _op1_sql() -> str:
    from skycap.llm.quality import sql

    return sql()


@query("op1_quality_rules", _op1_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.quality import quality

    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_stop_words", "longest_word")


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.suffix_dedup import suffix_dedup

    docs = table(spark, sf_dir, "documents")
    res = suffix_dedup(docs)
    return C.attach(docs, "doc_id", "text", res.select("k1", "k2", "n_bytes", "n_removed", "n_spans",
                                                       F.sha2("kept", 256).alias("kept_sha256")))


@query("op3_vector_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.vector_dedup import vector_dedup

    return vector_dedup(table(spark, sf_dir, "embeddings"))


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.substring_dedup import substring_dedup

    docs = table(spark, sf_dir, "documents")
    res = substring_dedup(docs)
    return C.attach(docs, "doc_id", "text", res.select("k1", "k2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm import pii

    out = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.KINDS[:4]
    spans = out.withColumns({"base": pii.spans_text(pii.all_spans(base)), "n_terms": F.size("terms"),
                             "spans": pii.spans_text(F.array_sort(F.concat(pii.all_spans(base), pii.term_spans())))})
    return spans.select("doc.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2("base", 256).alias("base_sha256"), "spans", F.col("n_terms").cast("long").alias("n_terms"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.html_text import extract_text

    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", F.coalesce(langid.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.bpe import bpe_round_trip

    out = bpe_round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op11_rank_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm.rank_bpe import rank_bpe

    out = rank_bpe(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm import periodic_runs as P

    out = P.periodic_runs(P.planted(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), P.best_run("runs").alias("best"),
                      F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                      F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def _op13_sql() -> str:
    from skycap.llm.vector_codes import sql

    return sql()


@query("op13_vector_codes", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skycap.llm import vector_codes as V

    out = V.vector_codes(table(spark, sf_dir, "embeddings"))
    return V.label_totals(out.codes).select("vec_id", "code", "error", "label_error", F.lit(out.sha256()).alias("codebooks_sha256"))
