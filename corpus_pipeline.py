"""Corpus pipeline: five stages from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet to the shared folder and read again as the next one's docs.  All but the
last return the columns of ``documents``; ``n_chars`` follows the text.

Defined results: a text that is null becomes empty where a stage rewrites texts;
a document whose words all go keeps its row with an empty text; of each group of
near duplicates one row stays, also where rows share an id or have none; rows
without words are no duplicates and all stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycap.llm import common as C
from skycap.llm import jaccard_join as J
from skycap.llm import langid, packing, pii
from skycap.llm import substring_dedup as S

#: A prediction below this share of the probability rejects the document.
LEAST_SCORE = 0.4

#: No SQL: trained model, connected components, tokenizer.
ORACLE_SQL = None


def _row(docs: DataFrame):
    """A document's own columns but its text as one struct: no stage's columns clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")


def _columns(docs: DataFrame, **new) -> list:
    """The columns of docs out of the struct, the text and others anew."""
    return [(new[c] if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: no ``und``, no doubtful prediction."""
    out = langid.identify(docs.select(_row(docs), "text"), langid.train(docs))
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*_columns(docs, text=F.col("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at a Jaccard similarity of 0.8 or more: that of
    least id (a missing id comes last), then of least key of its text, then of
    least other columns.

    Rows of equal text become one per task before the shuffle, so a text that
    stands in many rows is no hot key."""
    last = lambda c: (c.isNull(), c)
    texts = J.linked_texts(docs).where("n_shingles > 0")
    kept = texts.groupBy("label").agg(F.min(F.struct(*last(F.col("least")), "k1", "k2")).alias("first")).select("first.k1", "first.k2")
    k1, k2, t = C.keyed_text("text")
    wordless = ~t.rlike(r"[^ \t\n\x0B\f\r]")
    order = ["doc_id", *(c for c in docs.columns if c not in ("doc_id", "text")), "text"]
    # fields by number, whatever the columns are called
    fields = [x.alias(f"f{i}_{k}") for i, c in enumerate(order) for k, x in enumerate(last(F.col(f"`{c}`")))]
    rows = docs.where(~wordless).select(k1, k2, F.struct(*fields).alias("row")).groupBy("k1", "k2").agg(F.min("row").alias("row"))
    ones = rows.join(kept, ["k1", "k2"], "left_semi").select(
        *[F.col("row").getField(f"f{order.index(c)}_1").alias(c) for c in docs.columns])
    return docs.where(wordless).unionByName(ones)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 35 words that repeat; others as they are."""
    left = S.substring_dedup(docs, keep_layout=True).select("k1", "k2", "kept")
    k1, k2, _ = C.keyed_text("text")
    out = docs.select(_row(docs), k1, k2).join(left, ["k1", "k2"])
    return out.select(*_columns(docs, text=F.col("kept"), n_chars=F.length("kept").cast("long")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that disclose it."""
    out = pii.sanitised(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("personal_data", personal_data),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    C.prepare(spark)
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
