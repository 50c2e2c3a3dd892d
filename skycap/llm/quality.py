"""Quality rules: a table of thresholds compiled into one projection.

``measures`` adds the counts of a text (words, characters, symbols, repeated
lines, repeated five-word windows, stop words) and ``verdict`` turns a table of
rules - a ratio of two measures with its least and greatest value - into one boolean
expression.  Everything is built-in column functions in one pass over the
texts: no user functions, no shuffle.

Repeated windows are found by sorting one array of longs per text: the upper 40
bits are the window's hash, the lower 24 its position, so equal windows stand
next to each other; neighbours are then compared by their whole 64-bit hash.  A text
of more than ``MAX_PACKED`` windows sorts pairs of hash and position instead.

Defined results: a null or blank text has no words and fails the base rule
(fewer than ten words).  A ratio over nothing counts as 0.  Repeated rows are judged
one by one; columns named as the measures are replaced; no rows give no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
#: Windows of a text whose positions fit a packed key.
MAX_PACKED = 1 << 24
#: Repeated words fail above this percentage of all words.
MAX_REPEATED = 20

# fixed values: common function words of English, German, French and Spanish
STOP_WORDS = (
    "the of and to in a is that it for was with as be by on not he his but at are this have from or had an they which "
    "der die das und ist in zu den mit von für auf im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et est un une du en que qui dans pour pas au sur ne se ce il par plus avec sont "
    "el los las y que un una por con para se del no su al lo como más pero sus o este"
).split()


class Rule(NamedTuple):
    """low <= part / whole <= high."""

    part: str
    whole: str
    low: float
    high: float


#: Wide enough for any running prose, narrow tables and lists of symbols fail.
RULES = (
    Rule("word_chars", "n_words", 2.0, 14.0),       # mean length of a word
    Rule("n_symbols", "n_words", 0.0, 0.2),         # symbols to words
    Rule("n_stop_words", "n_words", 0.02, 1.0),     # share of function words
    Rule("n_dup_lines", "n_lines", 0.0, 0.5),       # repeated lines to lines
    Rule("longest_word", "one", 1.0, 1000.0),       # no blobs
)


def _words(text: Column) -> Column:
    t = F.btrim(text, F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACES}]+"))


def _repeat_positions() -> list[tuple[str, Column]]:
    """Layers of columns up to _at: ascending first words of windows that occur twice or more."""
    n = F.size("_words")
    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(none)
    low = F.lit((1 << 24) - 1).cast("long")
    keys = F.sort_array(F.transform("_grams", lambda g, i: g.bitwiseAND(F.lit(-(1 << 24)).cast("long")).bitwiseOR(i.cast("long"))))

    def near(x, other):  # equal upper 40 bits
        return F.coalesce(x.bitwiseXOR(other).between(0, (1 << 24) - 1), F.lit(False))

    k = F.col("_keys")
    close = F.filter("_keys", lambda x, i: near(x, F.get(k, i + 1)) | near(x, F.get(k, i - 1)))
    at = F.transform("_close", lambda x: x.bitwiseAND(low).cast("int"))
    g, p = F.col("_grams"), F.col("_near")

    def real(x, i):  # a neighbour among the few close ones has the same whole hash
        mine = F.get(g, x)
        return F.coalesce(*[F.when(F.get(g, F.get(p, i + d)) == mine, True) for d in (-1, 1, -2, 2)], F.lit(False))

    # texts with more windows than a key's position bits hold: hashes and positions side by side
    long = F.size("_grams") > MAX_PACKED
    pairs = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.cast("int").alias("i"))))
    w = F.col("_pairs")

    def twin(x, i):
        return F.coalesce(x["g"] == F.get(w, i + 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(w, i - 1)["g"], F.lit(False))

    at_long = F.sort_array(F.transform(F.filter("_pairs", twin), lambda x: x["i"]))
    return [("_grams", grams), ("_keys", F.when(~long, keys).otherwise(none)), ("_close", close), ("_near", at),
            ("_pairs", F.when(long, pairs)), ("_at", F.when(long, at_long).otherwise(F.sort_array(F.filter("_near", real))))]


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words, longest_word (long); columns of these names are replaced."""
    own = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "longest_word"}
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("doc")
    df = docs.select(rest, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumns({"_words": _words(F.col("_text")), "_lines": lines})
    for name, col in _repeat_positions():
        df = df.withColumn(name, col)
    at = F.col("_at")
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
                          F.lit(0), lambda a, x: a + x)
    stop = sorted({w for s in STOP_WORDS for w in (s, s.capitalize())})
    cols = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long"),
        "longest_word": F.coalesce(F.array_max(F.transform("_words", F.length)), F.lit(0)).cast("long"),
    }
    return C.computed(df, cols).select("doc.*", *cols)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def verdict(rules=RULES) -> Column:
    """All rules hold."""
    ok = F.lit(True)
    for r in rules:
        whole = F.lit(1.0) if r.whole == "one" else F.col(r.whole)
        ratio = F.coalesce(F.try_divide(F.col(r.part).cast("double"), whole.cast("double")), F.lit(0.0))
        ok = ok & ratio.between(r.low, r.high)
    return ok


def quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with the measures, base_failed and kept."""
    df = measures(docs, text)
    return df.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})


def sql(rules=RULES) -> str:
    """DuckDB SQL for the query over documents."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))
    tests = []
    for r in rules:
        ratio = f"{r.part}::DOUBLE" if r.whole == "one" else f"coalesce(CASE WHEN {r.whole} = 0 THEN NULL ELSE {r.part}::DOUBLE / {r.whole} END, 0)"
        tests.append(f"{ratio} BETWEEN {r.low} AND {r.high}")
    blank = r"[^ \t\n\x0B\f\r]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{blank}+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS ls FROM d),
g AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT rid, i, w, {', '.join(f'lead(w, {j}) OVER o AS w{j}' for j in range(1, WINDOW))}
      FROM g WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, {', '.join(f'w{j}' for j in range(1, WINDOW))}) AS c
      FROM v WHERE w{WINDOW - 1} IS NOT NULL),
p AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM h WHERE c > 1),
r AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM p GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
             coalesce(list_max(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS longest_word
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(f'({t})' for t in tests)} AS kept, n_lines, n_stop_words, longest_word
FROM b"""
