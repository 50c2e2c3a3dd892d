"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct five-word shingles.  Exact links at a
threshold t, in three steps:

1. *Global order.*  The shared-hash exchange tells each chunk which shingles
   other chunks hold, and how many chunks do.  Shingles are ordered by that
   number, then by hash.  A set whose shared shingles make up less than t of it
   cannot link and is left out; the rest index the shared ones among their first
   ``n - ceil(t * n) + 1`` shingles in that order (prefix filter).
2. *Groups.*  Sets that meet in an inverted list are connected by a star to the
   list's least member - linear in the list, not its square.  Connected sets
   form a group; every link lies within a group.
3. *Join within groups.*  Sets stand in order of size; every inverted list is
   a sorted array of positions, of which only the block that the size bound
   admits is read (index-level skipping).  The overlaps of a set with all others
   are derived from those of a highly similar set already answered, by the lists
   of the shingles in which the two differ (answer-level skipping).  Small groups
   share a block; groups of over ``BLOCK_SETS`` sets or ``BLOCK_ITEMS`` shingles are split into blocks that are
   joined pairwise by separate tasks; a task returns one label and one count of
   links per set, never pairs.

Equal texts are one set with a number of copies.  Shingles are told apart by
64-bit hashes.

Defined results: words are lower-cased in A-Z; a text with fewer than n words
is one shingle; a null, empty or blank text has no shingle and no link; no rows give
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C
from skycap.llm import components as CC
from skycap.llm.components import connected_components, merge_join

BLOCK_SETS = 4096
BLOCK_ITEMS = 4 << 20
#: Answers kept to derive others from.
ANSWERS = 4

SETS = "k1 long, k2 long, node long, n_shingles long, prefix binary, items binary"


# ---------------------------------------------------------------------------
# Shingle sets of a chunk
# ---------------------------------------------------------------------------
def shingle_sets(texts: C.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text in ascending order, index of each text's first plus the total)."""
    words, first = C.word_hashes(texts, lower=True)
    lens = np.diff(first)
    grams = C.rolling(words, n)
    ok = C.windows_inside(first, n)
    doc = np.repeat(np.arange(len(texts)), lens)[:len(grams)][ok]
    grams = grams[ok]
    short = np.flatnonzero((lens > 0) & (lens < n))
    if len(short):
        p = C.prefix_hash(words)
        whole = (p[first[short + 1]] - p[first[short]]) * C.powers(len(words) + 1)[1][first[short]]
        grams = np.concatenate([grams, C.mixed(whole + lens[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def _ask(n: int, n_ranges: int):
    def step(texts: C.Texts) -> pa.Table:
        h = np.unique(shingle_sets(texts, n)[0])
        return C.payload_table([(r, texts.chunk, C.pack6(h[lo:hi])) for r, lo, hi in C.by_range(h, n_ranges)])

    return step


def _survivors(n: int, percent: int):
    def step(texts: C.Texts, shared: np.ndarray) -> pa.Table:
        grams, first = shingle_sets(texts, n)
        size = np.diff(first)
        short = grams >> np.uint64(16)
        known, spread = shared >> np.uint64(16), (shared & np.uint64(0xFFFF)).astype(np.int64)
        rank = np.ones(len(grams), np.int64)  # chunks that hold the shingle
        if len(known):
            at = np.searchsorted(known, short)
            at[at == len(known)] = 0
            rank = np.where(known[at] == short, spread[at], 1)
        s, times = np.unique(short, return_counts=True)
        both = (rank > 1) | C.is_in(short, s[times > 1])
        upto = np.concatenate([[0], np.cumsum(both)])
        need = -(-percent * size // 100)
        live = (size > 0) & (upto[first[1:]] - upto[first[:-1]] >= need)
        prefix, items = [], []
        for i in range(len(texts)):
            if not live[i]:
                prefix.append(None)
                items.append(None)
                continue
            a, b = first[i], first[i + 1]
            g = grams[a:b]
            head = np.lexsort((g, rank[a:b]))[:size[i] - need[i] + 1]
            prefix.append(g[head][both[a:b][head]].tobytes())
            items.append(g.tobytes())
        return pa.table({"k1": texts.k1, "k2": texts.k2, "node": (np.int64(texts.chunk) << 32) + np.arange(len(texts)),
                         "n_shingles": size.astype(np.int64), "prefix": pa.array(prefix, pa.binary()),
                         "items": pa.array(items, pa.binary())})

    return step


def _prefix_rows(batches):
    for b in batches:
        node = b.column("node").to_numpy()
        parts = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)),
             pa.array(np.repeat(node, [len(p) for p in parts]))], ["shingle", "node"])


# ---------------------------------------------------------------------------
# Join of two blocks of sets
# ---------------------------------------------------------------------------
class Lists:
    """Inverted lists of the sets of a block: shingle number -> positions in order of size."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)  # a block that its group's hashes left empty has no set
        self.order = np.argsort(size, kind="stable")
        self.size = size[self.order]
        item = np.concatenate([sets[i] for i in self.order]) if sets else np.zeros(0, np.uint64)
        pos = np.repeat(np.arange(len(sets)), self.size)
        by = np.argsort(item, kind="stable")
        self.item, at = np.unique(item[by], return_index=True)
        self.pos, self.bounds = pos[by], np.append(at, len(by))

    def numbers(self, shingles: np.ndarray) -> np.ndarray:
        """Numbers of the lists of those shingles that have one."""
        at = np.searchsorted(self.item, shingles)
        at[at == len(self.item)] = 0
        return at[self.item[at] == shingles] if len(self.item) else at[:0]

    def count(self, numbers: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How often each position lo..hi-1 stands in the lists; only that block of a list is read."""
        a, b = self.bounds[numbers], self.bounds[numbers + 1]
        if hi - lo < len(self.order):
            # positions ascend within a list: the admitted block of every list by one search each
            base = numbers * (len(self.order) + 1)
            a, b = np.searchsorted(self._keys(), base + lo), np.searchsorted(self._keys(), base + hi)
        n = b - a
        total = int(n.sum())
        if not total:
            return np.zeros(hi - lo, np.int32)
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
        return np.bincount(self.pos[at] - lo, minlength=hi - lo).astype(np.int32)

    def _keys(self) -> np.ndarray:
        if not hasattr(self, "_flat"):
            owner = np.repeat(np.arange(len(self.item)), np.diff(self.bounds))
            self._flat = owner * (len(self.order) + 1) + self.pos
        return self._flat


def overlaps(queries: list[np.ndarray], lists: Lists, percent: int, tally: dict | None = None):
    """For each query set: (its number, positions that link with it).

    ``tally`` counts answers from scratch and derived ones, and list entries skipped.

    An answer is the overlap with every position; it comes from scratch, or from
    the kept answer of the most similar earlier query where less is to be read."""
    kept: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # set, overlaps from lo to hi
    for q in sorted(range(len(queries)), key=lambda i: len(queries[i])):
        s = queries[q]
        n = len(s)
        lo = int(np.searchsorted(lists.size, -(-percent * n // 100)))
        hi = int(np.searchsorted(lists.size, n * 100 // percent, side="right"))
        if lo >= hi:
            continue
        best, plus, minus = None, None, None
        for known in kept:
            if known[2] > lo or known[3] < hi:  # it does not hold every position asked for
                continue
            extra = np.setdiff1d(s, known[0], assume_unique=True)
            if len(extra) <= n // 4 and (best is None or len(extra) < len(plus)):
                best, plus = known, extra
        wide = int(np.searchsorted(lists.size, n * 125 // percent, side="right"))  # room for somewhat larger sets
        if best is not None:
            minus = np.setdiff1d(best[0], s, assume_unique=True)
            lo2, hi2 = best[2], best[3]
            have = best[1] + lists.count(lists.numbers(plus), lo2, hi2) - lists.count(lists.numbers(minus), lo2, hi2)
        else:
            lo2, hi2 = lo, max(hi, wide)
            have = lists.count(lists.numbers(s), lo2, hi2)
            kept = [*kept, (s, have, lo2, hi2)][-ANSWERS:]
        if tally is not None:
            tally["derived" if best is not None else "scratch"] += 1
            at = lists.numbers(s)
            tally["skipped"] += int((lists.bounds[at + 1] - lists.bounds[at]).sum()) - int(lists.count(at, lo2, hi2).sum())
        inter = have[lo - lo2:hi - lo2].astype(np.int64)
        union = n + lists.size[lo:hi] - inter
        yield q, np.flatnonzero(100 * inter >= percent * union) + lo


def join_blocks(nodes, sets, copies, nodes2, sets2, copies2, percent: int, same: bool):
    """Per set of both blocks: links to the other block (copies counted) and the
    least node of its component in these blocks."""
    lists = Lists(sets2)
    target, weights = nodes2[lists.order], copies2[lists.order]
    links = overlaps(sets, lists, percent)
    all_nodes = np.unique(np.concatenate([nodes, nodes2]))
    label = np.arange(len(all_nodes))
    left, right = np.searchsorted(all_nodes, nodes), np.searchsorted(all_nodes, target)
    count = np.zeros(len(all_nodes), np.int64)
    for q, hit in links:
        other = right[hit]
        other_weight = weights[hit]
        if same:
            count[left[q]] += int(other_weight[other != left[q]].sum()) + int(copies[q]) - 1
        else:
            count[left[q]] += int(other_weight.sum())
            count[other] += int(copies[q])
        roots = np.unique(np.append(label[other], label[left[q]]))
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]
    return all_nodes, count, all_nodes[label]


UNIT = "node long, n_links long, label long"


def _join_unit(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        block = table.column("block").to_numpy()
        a, b = int(table.column("a")[0].as_py()), int(table.column("b")[0].as_py())
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        order = np.argsort(node)
        one, two = (order[block[order] == x] for x in (a, b))
        pick = lambda at: (node[at], [sets[i] for i in at], copies[at])
        n, c, lab = join_blocks(*pick(one), *pick(two), percent, a == b)
        return pa.table({"node": n, "n_links": c, "label": lab})

    return run


def linked_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(k1, k2, n_shingles, least, n_links, label) per distinct text: least is the
    least id of its rows, label is the same for all texts reachable by links."""
    spark = docs.sparkSession
    C.prepare(spark)
    n_bytes = C.text_bytes(docs, text)
    n_ranges = C.range_count(n_bytes // 6)
    chunks = C.chunked(docs, text, C.chunk_count(n_bytes))
    asked = C.per_chunk(chunks, _ask(n, n_ranges), C.PAYLOAD)
    shared = C.exchange(asked, C.shared_answers(6, counts=True))
    sets = C.written(C.with_answers(chunks, shared, _survivors(n, percent), SETS), "jaccard-sets")

    # groups: stars within inverted lists, then connected components
    rows = sets.where(F.col("prefix").isNotNull()).select("node", "prefix").mapInArrow(_prefix_rows, "shingle long, node long")
    least = rows.groupBy("shingle").agg(F.min("node").alias("dst"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = merge_join(rows, least, "shingle").select(F.col("node").alias("src"), "dst").where("src != dst").distinct()
    stars = C.written(stars, "jaccard-stars")
    ends = stars.select(F.col("src").alias("id")).unionByName(stars.select(F.col("dst").alias("id"))).distinct()
    groups = connected_components(ends, stars).withColumnRenamed("comp", "group")

    # copies and least document of each distinct text
    k1, k2, _ = C.keyed_text(text)
    ids = docs.select(F.col(doc_id).alias("doc_id"), k1, k2)
    nodes = C.written(
        merge_join(sets.select("k1", "k2", "node", "n_shingles"),
                   ids.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), ["k1", "k2"]),
        "jaccard-nodes")

    # blocks of each group by hash, pairs of blocks as units
    members = merge_join(merge_join(sets.where(F.col("prefix").isNotNull()).select("node", "items"),
                                    groups.withColumnRenamed("id", "node"), "node"), nodes.select("node", "copies"), "node")
    sizes = merge_join(groups, sets.select(F.col("node").alias("id"), "n_shingles"), "id").groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_ITEMS)).alias("blocks"),
        F.count("*").alias("sets"), F.sum("n_shingles").alias("items"))
    # small groups share a block: sets of different groups have no prefix shingle in common and so no link
    small = sizes.where("blocks = 1").agg(F.sum("sets"), F.sum("items")).first()
    bins = max(1, *(-(-2 * (x or 0) // most) for x, most in zip(small, (BLOCK_SETS, BLOCK_ITEMS))))
    unit = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("group"), F.lit(bins))).otherwise(F.col("group"))
    placed = merge_join(members, sizes.select("group", "blocks"), "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        unit.alias("group"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "copies", "block", "items")
    parts = C.written(units.groupBy("group", "a", "b").applyInArrow(_join_unit(percent), UNIT), "jaccard-links")

    # groups of one block are settled; labels of split ones meet over their blocks
    labels = parts.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min("label").alias("label"),
                                       F.max("label").alias("high"))
    split = parts.select(F.col("node").alias("src"), F.col("label").alias("dst"))
    seams = labels.where("label != high").select(F.col("label").alias("id")).limit(1).count()
    if seams:
        edges = C.written(split.where("src != dst").distinct(), "jaccard-seams")
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        whole = connected_components(ends, edges)
        labels = merge_join(labels, whole.withColumnRenamed("id", "node"), "node", "left").select(
            "node", "n_links", F.coalesce("comp", "label").alias("label"))
    return merge_join(nodes, labels.select("node", "n_links", "label"), "node", "left").select(
        "k1", "k2", "n_shingles", "least",
        F.when(F.col("n_shingles") == 0, 0).otherwise(F.coalesce("n_links", F.col("copies") - 1)).alias("n_links"),
        F.coalesce("label", "node").alias("label"))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) per document: size of its
    shingle set, number of documents with 100 * intersection >= percent * union, least
    doc_id reachable by links."""
    full = linked_texts(docs, doc_id, text, n, percent)
    k1, k2, _ = C.keyed_text(text)
    ids = docs.select(F.col(doc_id).alias("doc_id"), k1, k2)
    first = full.groupBy("label").agg(F.min("least").alias("component_id"))
    out = CC.salted_join(full, first, "label", "k1").select("k1", "k2", "n_shingles", "n_links", "component_id")
    return merge_join(ids, out, ["k1", "k2"]).select(
        "doc_id", "n_shingles", "n_links", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
