"""PII: patterns, and information-theoretic sanitisation of the terms around them.

*Base spans* are e-mail addresses, IPv4 addresses, card numbers and phone
numbers, found per kind from left to right without overlap.

*Disclosure.*  A term of a text that holds a protected entity may give it away.
Entities are the values themselves and what recurs where values do not: the domain
of an e-mail address, the country and area digits of a phone number, and the kind of a
value where nothing finer of that kind recurs.  How much a term gives away follows from
co-occurrence in the whole corpus: with N documents, n(c) of them holding entity c, and p
the share of the term's documents that do, the pointwise mutual information
log2(p * N / n(c)) is the part of c's information content log2(N / n(c)) that the term
reveals.  A term that reveals at least ``share`` of it for some entity, in ``min_texts``
different texts or more, exceeds the threshold if so many meetings are no chance: over
all recurring entities and all terms beside values, fewer than ``CHANCE`` pairs would meet
so often if terms fell on documents at random (Chernoff's bound of the binomial tail).
The term is removed where all its documents hold the entity, else generalised to a
placeholder - wherever it stands, in every text of the corpus.  Words of one or two
letters and runs of the letters a to f are no terms.

Column functions only.  Document frequencies come from all documents: each
task sums its terms before the shuffle.  Texts that hold a value are few; pairs
are counted for entities of ``min_texts`` texts or more (no others can pass).
The terms over the threshold are met by the words of all texts, and only the texts
that hold one are searched for its places.

Offsets count code points.  Matches are laid out and texts rewritten in pieces of
``PIECE`` spans, in time linear in a text's matches (the pieces' heads, one in 256 spans,
are found from the text's start).

Defined results: a null text is empty and has no spans.  Equal rows get equal
spans.  Kinds may overlap each other; sanitised text skips a span that starts
inside the one before.  No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

KINDS = ("email", "ip", "card", "phone", "term")
SHARE = 0.8
MIN_TEXTS = 3

# fixed values: the patterns of the base kinds.  \G lets a match start right
# after the one before; otherwise a run is tried from its first character only.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
# chains of digits of the lengths that a card has; longer or shorter chains fail as a whole
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Pairs of entity and term that may pass by chance, expected over the whole corpus.
CHANCE = 0.01
#: Spans that are laid out together.
PIECE = 256

TERMS = "array<struct<start:int,end:int,value:string,part:double>>"
SPAN = "array<struct<start:int,end:int,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))


def _luhn_ok(m: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _prefix(values: Column, zero: Column, join) -> Column:
    """Running values of a materialised array, each over what stands before it; the last over
    all.  Heads of pieces of ``PIECE`` first, then within each piece, as an array that grows by
    one copies itself."""
    n = F.size(values)
    pieces = F.ceil(n / PIECE).cast("int")
    piece = lambda c: F.slice(values, c * PIECE + 1, PIECE)
    grow = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))
    ends = F.transform(F.sequence(F.lit(0), pieces - 1), lambda c: F.aggregate(piece(c), zero, join))
    heads = F.aggregate(ends, F.array(zero), grow)
    inner = lambda h, c: F.slice(F.aggregate(piece(c), F.array(h), grow), 2, PIECE)
    # the head after the last piece has no values of its own
    running = F.flatten(F.transform(heads, lambda h, c: F.when(c < pieces, inner(h, c)).otherwise(F.array().cast("array<int>"))))
    return F.when(n > 0, F.concat(F.array(zero), running)).otherwise(F.array(zero))


def _located(texts: DataFrame, kinds: dict) -> DataFrame:
    """texts (with a column text) with an array of spans for each kind (pattern, guard, test of
    a match): offsets are running sums of the lengths of the matches and the text between.

    Each layer is materialised, so that no lambda evaluates it again; the work is linear in the
    matches of a text but for the pieces' copies."""
    none = F.array().cast("array<string>")
    t = F.col("text")
    pattern = {k: p if isinstance(p, Column) else F.lit(p) for k, (p, _, _) in kinds.items()}
    out = C.computed(texts, {f"_{k}_hit": F.when(g, F.regexp_extract_all(t, pattern[k], F.lit(0))).otherwise(none) for k, (_, g, _) in kinds.items()}
                     | {f"_{k}_gap": F.when(g, F.split(t, pattern[k], -1)).otherwise(none) for k, (_, g, _) in kinds.items()})
    both = lambda g, h: F.length(g) + F.length(h)
    out = C.computed(out, {f"_{k}_len": F.zip_with(F.slice(f"_{k}_gap", 1, F.size(f"_{k}_hit")), f"_{k}_hit", both) for k in kinds})
    out = C.computed(out, {f"_{k}_end": F.slice(_prefix(F.col(f"_{k}_len"), F.lit(0), lambda a, x: a + x), 2, F.greatest(F.lit(0), F.size(f"_{k}_hit")))
                           for k in kinds})
    passing = lambda ok: lambda s: ok(s["value"])
    span = lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("value"))
    out = C.computed(out, {k: F.filter(F.zip_with(f"_{k}_end", f"_{k}_hit", span), passing(ok)) for k, (_, _, ok) in kinds.items()})
    return out.drop(*[f"_{k}_{x}" for k in kinds for x in ("hit", "gap", "len", "end")])


def _rewritten(texts: DataFrame, spans: str, out: str) -> DataFrame:
    """texts with ``out``: the text with its spans (start, end, label; by start) replaced by their
    labels.  A span that starts inside one before is skipped, its end cut off all the same."""
    s = F.col(spans)
    df = C.computed(texts, {"_stop": F.transform(s, lambda x: x["end"])})
    df = C.computed(df, {"_at": _prefix(F.col("_stop"), F.lit(0), lambda a, x: F.greatest(a, x))})
    step = lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["label"].alias("label"))
    df = C.computed(df, {"_kept": F.filter(F.zip_with(s, F.slice("_at", 1, F.size(s)), step), lambda x: x["start"] >= x["at"]),
                         "_last": F.element_at("_at", -1)})
    kept = F.col("_kept")
    # pieces of the text with their spans; a piece is short, so cutting it is cheap
    part = lambda c: F.slice(kept, c * PIECE + 1, PIECE)
    base, stop = lambda c: F.get(kept, c * PIECE)["at"], lambda c: F.element_at(part(c), -1)["start"]
    cut = lambda c: F.struct(base(c).alias("base"), part(c).alias("part"), F.substring("text", base(c) + 1, stop(c) - base(c)).alias("piece"))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(kept) / PIECE).cast("int") - 1), cut)
    df = C.computed(df, {"_pieces": F.when(F.size(kept) > 0, pieces)})
    one = lambda p: F.array_join(F.transform(p["part"], lambda x: F.concat(
        F.substring(p["piece"], x["at"] - p["base"] + 1, x["start"] - x["at"]), x["label"])), "")
    text = F.concat(F.coalesce(F.array_join(F.transform("_pieces", one), ""), F.lit("")), F.substring("text", F.col("_last") + 1, F.length("text")))
    return C.computed(df, {out: F.when(F.size(s) > 0, text).otherwise(F.col("text"))}).drop("_stop", "_at", "_kept", "_last", "_pieces")


def base_spans(texts: DataFrame) -> DataFrame:
    """texts (with a column text) and its spans: one array per base kind."""
    t = F.col("text")
    digit = t.rlike("[0-9]")
    return _located(texts, {
        "email": (EMAIL, t.contains("@"), lambda m: F.lit(True)),
        "ip": (IP, digit & t.contains("."), _ip_ok),
        "card": (CARD, digit, _luhn_ok),
        "phone": (PHONE, t.contains("+"), _phone_ok),
    })


def all_spans(kinds) -> Column:
    """Spans of the given kind columns with their kind, by start, then kind in order."""
    def coded(k):
        code = F.lit(KINDS.index(k))
        return F.transform(k, lambda s: F.struct(s["start"].alias("start"), code.alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    parts = [coded(k) for k in kinds]
    return F.array_sort(F.concat(*parts))


def term_spans() -> Column:
    """The terms in the form of ``all_spans``."""
    return F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), s["end"].alias("end"),
                                                   s["value"].alias("value")))


def spans_text(spans: Column) -> Column:
    """kind:start:end joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _is_term(word: Column) -> Column:
    """Letters that may name something: three or more, and no run of hexadecimal digits."""
    return (F.length(word) >= 3) & ~word.rlike("^[a-f]+$")


def _lower_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def _entities(spans: str) -> Column:
    """Entities that the spans of a text stand for, each once: values, kinds, e-mail domains, phone areas."""
    def named(kind, what):
        return F.concat_ws(":", kind.cast("string"), what)

    kinds = F.transform(spans, lambda s: named(s["kind"], F.lit("")))
    values = F.transform(spans, lambda s: named(s["kind"], s["value"]))
    email = F.transform(F.filter(spans, lambda s: s["kind"] == KINDS.index("email")),
                        lambda s: named(s["kind"], F.concat(F.lit("@"), F.lower(F.substring_index(s["value"], "@", -1)))))
    phone = F.transform(F.filter(spans, lambda s: s["kind"] == KINDS.index("phone")),
                        lambda s: named(s["kind"], F.concat(F.lit("+"), F.substring(_digits(s["value"]), 1, 4))))
    return F.array_distinct(F.concat(kinds, values, email, phone))


def scored_terms(docs: DataFrame, text: str = "text", share: float = SHARE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(term, part) of the terms over the threshold; part is the largest part of an entity's information that the term reveals."""
    keyed = docs.select(*C.keyed_text(text))
    total = docs.count()
    spans = C.computed(base_spans(keyed.where(F.col("text").rlike("[@+]|[0-9]"))), {"spans": all_spans(KINDS[:4])}).where(F.size("spans") > 0)
    blank = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("label")))
    outside = _rewritten(C.computed(spans, {"blank": blank}), "blank", "outside")
    rows = outside.select("k1", "k2", _entities("spans").alias("entities"), F.filter(_lower_words(F.col("outside")), _is_term).alias("terms"))
    # equal texts have equal entities and terms: one row with their number
    holders = C.written(rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"),
                                                     F.first("terms").alias("terms")), "pii-holders")
    held = C.written(holders.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(
        F.count("*").alias("texts"), F.sum("copies").alias("n_entity")).where(F.col("texts") >= min_texts).drop("texts"), "pii-entities")
    # a kind stands for its values only where none of them, nor a domain or area, recurs
    is_kind = F.length("entity") == 2
    finer = [r.kind for r in held.where(~is_kind).select(F.substring("entity", 1, 2).alias("kind")).distinct().collect()]
    held = held.where(~(is_kind & F.col("entity").isin(finer))) if finer else held
    recurring = holders.select("k1", "k2", F.explode("entities").alias("entity")).join(held, "entity")
    pairs = recurring.join(holders.select("k1", "k2", "copies", "terms"), ["k1", "k2"]).select(
        "entity", "n_entity", "copies", F.explode("terms").alias("term")).where("term != ''")
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_both"),
                                                F.first("n_entity").alias("n_entity")).where(F.col("texts") >= min_texts)
    # document frequency of every term of the corpus, summed per task before the shuffle
    freq = keyed.select(F.explode(_lower_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    # pairs that might meet by chance, and the entropy of the share of the term's texts that hold the entity
    # against that of all; copies of a text are one observation
    beside = holders.select(F.explode("terms").alias("term")).where("term != ''").distinct().count()
    most = math.log(max(1, held.count() * beside) / CHANCE)
    p, q = F.col("n_both") / F.col("n_term"), F.col("n_entity") / F.lit(float(max(total, 1)))
    entropy = p * F.ln(p / q) + F.when(p < 1, (1 - p) * F.ln((1 - p) / (1 - q))).otherwise(0.0)
    scored = joint.join(freq, "term").where(p > q).withColumn("information", -F.log2(q)).withColumn("revealed", F.log2(p / q)).withColumn(
        "evidence", F.col("texts") / p * entropy).withColumn("whole", p >= 1)
    over = scored.where((F.col("evidence") >= most) & (F.col("revealed") >= share * F.col("information"))).groupBy("term").agg(
        F.max(F.when(F.col("whole"), F.lit(1.0)).otherwise(F.least(F.lit(0.999), F.col("revealed") / F.col("information")))).alias("part"))
    return C.written(over, "pii-terms")


def disclosing_terms(docs: DataFrame, text: str = "text", share: float = SHARE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(k1, k2, terms) of the texts with terms over the threshold; terms are
    spans with the part of an entity's information that they reveal."""
    keyed = docs.select(*C.keyed_text(text))
    over = scored_terms(docs, text, share, min_texts)
    words = keyed.select("k1", "k2", F.explode(_lower_words(F.col("text"))).alias("term")).join(over, "term").distinct()
    hits = words.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "part"))).alias("parts"))
    # words are letters only, so they need no quoting in a pattern
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("parts"), "|"), F.lit(r")(?!\p{L})"))
    texts = base_spans(keyed.join(hits, ["k1", "k2"]).groupBy("k1", "k2").agg(
        F.first("text").alias("text"), F.first("parts").alias("parts"))).withColumn("spans", all_spans(KINDS[:4]))
    # a word that touches a base span is replaced with it
    clear = lambda w: ~F.exists("spans", lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"]))
    places = _located(C.computed(texts, {"pattern": pattern}), {"places": (F.col("pattern"), F.lit(True), lambda m: F.lit(True))})
    terms = F.transform(F.filter("places", clear), lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"),
        F.coalesce(F.try_element_at("parts", F.lower(w["value"])), F.lit(0.0)).alias("part")))
    return places.select("k1", "k2", terms.alias("terms")).where(F.size("terms") > 0)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(doc, k1, k2, text): a document's own columns stand in one struct, whatever their names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *C.keyed_text(text))


def personal_data(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """(doc, email, ip, card, phone, terms) per row: its columns as a struct and arrays of spans."""
    C.prepare(docs.sparkSession)
    base = base_spans(_keyed(docs, text)).drop("text")
    terms = disclosing_terms(docs, text, **limits)
    return base.join(terms, ["k1", "k2"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(TERMS))).drop("k1", "k2")


def sanitised(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """docs with base spans replaced by [EMAIL], [IP], [CARD], [PHONE], terms
    that reveal all of a value removed and other disclosing terms replaced by [TERM]."""
    C.prepare(docs.sparkSession)
    # the other columns go by number, so that no name of theirs clashes with one of these
    number = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c != text}
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in number.items()], *C.keyed_text(text))
    found = base_spans(keyed.join(disclosing_terms(docs, text, **limits), ["k1", "k2"], "left"))
    labelled = lambda spans, label: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label")))
    spans = [labelled(F.col(k), lambda _, name=f"[{k.upper()}]": F.lit(name)) for k in KINDS[:4]]
    spans.append(labelled(F.coalesce("terms", F.array().cast(TERMS)), lambda s: F.when(s["part"] >= 1.0, "").otherwise("[TERM]")))
    done = _rewritten(C.computed(found, {"spans": F.array_sort(F.concat(*spans))}), "spans", "clean")
    return done.select(*[F.col("clean" if c == text else number[c]).alias(c) for c in docs.columns])
