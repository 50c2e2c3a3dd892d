"""Language identification by words first, character n-grams second.

Training counts, per language, lower-case words and the character n-grams
(n = 1 to 4) of words between boundary marks.  A word seen in training scores
its log frequency per language; an unseen word falls back to the average log
frequency of its 4-grams, or 3-grams where no 4-gram is known, and so on to
single characters.  A text's scores are summed over all its words; the
prediction is the best language (the first by name on ties) and its score the
share that the scores' exponentials give it, softened over the square root of
the number of words.

Training uses at most about ``max_rows`` labelled rows, picked by a hash of the id,
and keeps the ``top_words`` words and ``top_grams`` n-grams per language and length; the
model is collected and broadcast, so its size is bounded by these parameters
and the number of languages.  Prediction covers all texts as a whole.

Defined results: ``und`` with score 0 for a null text or one without a letter,
and for all texts where nothing could be learned.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skycap.llm import common as C
from skycap.llm.bpe import slices

MAX_ROWS = 10_000
TOP_WORDS = 50_000
TOP_GRAMS = 20_000
LONGEST = 4
CACHE_WORDS = 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


class Table:
    """Log frequencies per language of some strings: one row of a matrix each."""

    def __init__(self, keys: list[str], rows: np.ndarray):
        self.keys, self.rows = keys, np.asarray(rows, np.float32)

    def __getstate__(self):  # compact: the strings as one
        return "\n".join(self.keys), len(self.keys), self.rows

    def __setstate__(self, state):
        joined, n, self.rows = state
        self.keys = joined.split("\n") if n else []

    def index(self) -> dict[str, int]:
        return {k: i for i, k in enumerate(self.keys)}


class Model:
    """Tables of words and of n-grams of 1, 2, ... characters."""

    def __init__(self, langs: list[str], words: Table, grams: list[Table]):
        self.langs, self.words, self.grams = langs, words, grams


class Scorer(dict):
    """Row numbers of the scores of words; an unseen word is scored when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.langs, self.words = model.langs, model.words
        self.grams = [(t.index(), t.rows) for t in model.grams]
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update(self.words.index())
        self.known = len(self)
        self.table = self.words.rows
        self.fresh: list[np.ndarray] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.table) + len(self.fresh)
        self.fresh.append(self.score_unseen(word))
        return n

    def score_unseen(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        for n in range(len(self.grams), 0, -1):
            index, rows = self.grams[n - 1]
            hits = [index[g] for i in range(len(marked) - n + 1) if (g := marked[i:i + n]) in index]
            if hits:
                return rows[hits].sum(axis=0) / np.float32(len(hits))
        return np.zeros(len(self.langs), np.float32)

    def scores(self, numbers: list[int]) -> np.ndarray:
        if self.fresh:
            self.table = np.concatenate([self.table, np.stack(self.fresh)])
            self.fresh = []
        return self.table[numbers]


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy("lang", *keys).agg(F.sum("n").alias("n"))


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """Share of each language's rows so that about ``most`` are taken: every language may give
    as many as any other, and small ones give all they have."""
    out, left = {}, most
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(sizes) - i))
        out[lang] = take / n
        left -= take
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS,
          top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> Model:
    """Model from the rows with a label that are not held out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("id"), F.lit(True)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    rates = [(la, int(share * (1 << 30))) for la, share in shares(sizes, max_rows).items()]
    if any(r < 1 << 30 for _, r in rates):
        rate = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, rate long"))
        rows = rows.join(rate, "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("rate")).drop("rate")
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    words = C.written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "langid-words")
    by_size = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    sizes = F.array(*[F.lit(n) for n in range(1, LONGEST + 1)])
    grams = words.withColumn("marked", marked).withColumn("size", F.explode(sizes)).where(F.length("marked") >= F.col("size"))
    grams = grams.withColumn("gram", F.explode(F.expr("transform(sequence(1, length(marked) - size + 1), i -> substring(marked, i, size))")))
    grams = _counts(grams, ["size", "gram"])
    one = words.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n")
    both = one.unionByName(grams)
    top = both.withColumn("r", F.row_number().over(by_size)).where(
        F.col("r") <= F.when(F.col("size") == 0, top_words).otherwise(top_grams))
    sums = {(r["lang"], r["size"]): r["n"] for r in both.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({la for la, _ in sums})
    place = {la: i for i, la in enumerate(langs)}
    # absent entries score as half a count
    floor = {s: np.array([math.log(0.5 / sums.get((la, s), 1)) for la in langs]) for s in range(LONGEST + 1)}
    keys: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    cells: list[list[tuple[int, int, float]]] = [[] for _ in range(LONGEST + 1)]
    for r in top.select("lang", "size", "gram", "n").toLocalIterator():
        size, at = r["size"], place[r["lang"]]
        row = keys[size].setdefault(r["gram"], len(keys[size]))
        cells[size].append((row, at, math.log(r["n"] / sums[r["lang"], size])))
    tables = []
    for size in range(LONGEST + 1):
        rows = np.tile(floor[size], (len(keys[size]), 1)).reshape(len(keys[size]), len(langs))
        for row, at, value in cells[size]:
            rows[row, at] = value
        tables.append(Table(list(keys[size]), rows))
    return Model(langs, tables[0], tables[1:])


def predict(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    langs = scorer.langs
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, best
    if len(scorer) > scorer.known + CACHE_WORDS:
        scorer.restart()
    numbers: list[int] = []
    ends = []
    look = scorer.__getitem__
    for t in texts:
        if t:
            words = _WORD.findall(t.lower())
            if any(c.isalpha() for w in words for c in w):  # not only number signs
                numbers += map(look, words)
        ends.append(len(numbers))
    upto = np.zeros((len(numbers) + 1, len(langs)))
    np.cumsum(scorer.scores(numbers), axis=0, dtype=np.float64, out=upto[1:])
    ends = np.array(ends)
    counts = np.diff(ends, prepend=0)
    sums = upto[ends] - upto[ends - counts]
    soft = sums / np.sqrt(np.maximum(counts, 1))[:, None]
    soft = np.exp(soft - soft.max(axis=1, keepdims=True))
    share = soft.max(axis=1) / soft.sum(axis=1)
    for i in np.flatnonzero(counts):
        names[i], best[i] = langs[int(sums[i].argmax())], share[i]
    return names, best


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of those names are replaced)."""
    spark = docs.sparkSession
    C.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])

    def run(batches):
        scorer = C.worker_slot(shared.value, lambda: Scorer(shared.value))
        for b in batches:
            column = b.column(text)
            lengths = pa.compute.utf8_length(column).fill_null(0).to_pylist()
            names, best = [], []
            for lo, hi in slices(list(map(range, lengths))):  # of texts of these lengths
                n, s = predict(scorer, column.slice(lo, hi - lo).to_pylist())
                names += n
                best.append(s)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(np.concatenate(best) if best else [], pa.float64())],
                [*b.schema.names, "lang_pred", "score"])
        C.give_back()

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)
