"""Byte-pair encoding and decoding with segment trees.

A text is cut at special tokens, then into pre-tokens as byte-level BPE does.
For every pre-token a segment tree holds the merge rank of each adjacent pair of
symbols (leaf i: the pair that starts at symbol i).  The root is the leftmost
pair of lowest rank; it is merged, the leaves of the two pairs around it get new
ranks, and their paths to the root are renewed, until no pair can be merged.
Trees of short pre-tokens are worked on together, one row of an array each.

Each distinct piece of text between spaces is encoded once and kept in a
bounded cache of the Python worker.  Decoding joins the bytes of the tokens.
The vocabulary file is read on the driver and broadcast (its size does not
depend on the data).

Defined results: a null text is empty: no ids, empty decoded text.  Ids come as
little-endian unsigned 32-bit integers in one binary value.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

NO_PAIR = np.int64(1) << 62
#: Pre-tokens up to this many bytes are merged in rows of one array.
ROW_BYTES = 64
CACHE_PIECES = 300_000
SLICE_CHARS = 1 << 20

# white space as Unicode has it, which differs from str.isspace
_WS = "\t-\r \x85\xa0  -     　"
#: Pieces that no pre-token crosses: a word with the one space before it, or white space.
_PIECES = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Two white-space characters in a row, where a piece may hold more than one word's space.
_WIDE = re.compile(f"[{_WS}]{{2}}")
# fixed value: the pattern that defines byte-level pre-tokens
_PRE_TOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^{ws}\p{L}\p{N}]+|[{ws}]+(?![^{ws}])|[{ws}]+".replace("{ws}", _WS))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    itself where it is printable and not a space, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key):
        self.fresh.append(key)
        self[key] = n = len(self)
        return n


def gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that start at begin, one after the other, and their lengths."""
    upto = np.cumsum(count)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.repeat(begin - (upto - count), count) + np.arange(total)], count


class Encoder:
    """Encoder of one vocabulary file (the JSON form with vocab, merges and added tokens)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab = data["model"]["vocab"]
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        back = {s: b for b, s in enumerate(symbols)}
        words: dict[int, bytes] = {i: bytes(back[c] for c in w) for w, i in vocab.items()}
        self.special: dict[str, int] = {}
        for t in data["added_tokens"]:
            if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r}: only plain ones are supported")
            self.special[t["content"]] = t["id"]
            words[t["id"]] = t["content"].encode()
        cut = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(cut) + ")") if cut else None
        size = max(words) + 1
        lens = np.array([len(words.get(i, b"")) for i in range(size)])
        self.token_stop = np.cumsum(lens)
        self.token_len = lens
        self.token_bytes = np.frombuffer(b"".join(words.get(i, b"") for i in range(size)), np.uint8)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.find = {int(k): (int(r), int(m)) for k, r, m in zip(self.pair, self.rank, self.made)}
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.flat, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # -- merging ------------------------------------------------------------
    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, -1 where there is none."""
        key = (a << 32) | b
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where((a >= 0) & (b >= 0) & (self.pair[at] == key), at, -1)

    def _leaf(self, a, b, i):
        """Value of leaf i: rank and, for the leftmost of equals, i."""
        at = self._look_up(a, b)
        return np.where(at >= 0, (self.rank[at] << 20) | i, NO_PAIR)

    def merge_rows(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each) of short pre-tokens, all trees side by side."""
        n = len(tokens)
        size = np.fromiter(map(len, tokens), np.int64, n)
        m = 1 << max(1, int(size.max() - 1).bit_length())
        sym = np.full((n, m + 1), -1, np.int64)
        sym[np.arange(m + 1)[None, :] < size[:, None]] = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        after = np.broadcast_to(np.arange(1, m + 2), (n, m + 1)).copy()  # next live symbol
        before = np.broadcast_to(np.arange(-1, m), (n, m + 1)).copy()
        tree = np.full((n, 2 * m), NO_PAIR, np.int64)
        tree[:, m:] = self._leaf(sym[:, :m], sym[:, 1:], np.arange(m)[None, :])
        for node in range(m - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        live = np.flatnonzero(tree[:, 1] < NO_PAIR)
        mask = (1 << 20) - 1

        def renew(rows, leaf, value):
            node = leaf + m
            tree[rows, node] = value
            while node.size and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(live):
            i = tree[live, 1] & mask
            j = after[live, i]
            at = self._look_up(sym[live, i], sym[live, j])
            k = after[live, j]  # symbol after the merged pair
            sym[live, i] = self.made[at]
            sym[live, j] = -1
            after[live, i] = k
            inside = k <= m
            before[live[inside], k[inside]] = i[inside]
            nxt = np.where(inside, sym[live, np.minimum(k, m)], -1)
            renew(live, j, NO_PAIR)
            renew(live, i, self._leaf(sym[live, i], nxt, i))
            p = before[live, i]
            some = p >= 0
            rows, p = live[some], p[some]
            if len(rows):
                renew(rows, p, self._leaf(sym[rows, p], sym[rows, i[some]], p))
            live = live[tree[live, 1] < NO_PAIR]
        alive = sym >= 0
        return sym[alive], alive.sum(axis=1)

    def merge_one(self, token: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        sym = [int(self.of_byte[b]) for b in token]
        n = len(sym)
        m = 1 << max(1, (n - 1).bit_length())
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (1 << 62, 0)
        tree = [none] * (2 * m)

        def leaf(i):
            j = after[i]
            hit = self.find.get((sym[i] << 32) | sym[j]) if j < n else None
            return (hit[0], i) if hit else none

        for i in range(n):
            tree[m + i] = leaf(i)
        for node in range(m - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def renew(i, value):
            node = m + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] is not none and tree[1][0] < none[0]:
            i = tree[1][1]
            j = after[i]
            sym[i], sym[j] = self.find[(sym[i] << 32) | sym[j]][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            renew(j, none)
            renew(i, leaf(i))
            if before[i] >= 0:
                renew(before[i], leaf(before[i]))
        return [s for s in sym if s >= 0]

    # -- texts --------------------------------------------------------------
    def _learn(self, keys: list[str]) -> None:
        """Encode the pieces of new cache keys, in order."""
        tokens: list[bytes] = []
        sizes = []
        for key in keys:
            if key[:1] == "\0":
                piece = key[1:]
                if piece[:1] == "\0" and piece[1:] in self.special:
                    tokens.append(key.encode())
                    sizes.append(1)
                    continue
            else:
                if key.isalpha():  # a space and letters are one pre-token
                    tokens.append(b" " + key.encode())
                    sizes.append(1)
                    continue
                piece = " " + key
            parts = _PRE_TOKENS.findall(piece)
            tokens += [t.encode() for t in parts]
            sizes.append(len(parts))
        number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        classes: dict[int, list[bytes]] = {}
        for t in number:
            classes.setdefault(-1 if t[:2] == b"\0\0" or len(t) > ROW_BYTES else (len(t) - 1).bit_length(), []).append(t)
        at, flat, count = [], [], []
        for c, group in classes.items():
            at.append(np.fromiter(map(number.__getitem__, group), np.int64, len(group)))
            if c >= 0:
                ids, n = self.merge_rows(group)
            else:
                special = {b"\0\0" + k.encode(): [i] for k, i in self.special.items()}
                lists = [special.get(t) or self.merge_one(t) for t in group]
                ids, n = np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists])
            flat.append(ids)
            count.append(n)
        if not at:
            ids_of, n_of, first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            ids_of, n_by, where = np.concatenate(flat), np.concatenate(count), np.concatenate(at)
            n_of, first = np.empty(len(where), np.int64), np.empty(len(where), np.int64)
            n_of[where], first[where] = n_by, np.cumsum(n_by) - n_by
        which = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        ids, n = gathered(ids_of, first[which], n_of[which])
        upto = np.concatenate([[0], np.cumsum(n)])
        cut = upto[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        self.begin = np.concatenate([self.begin, cut[:-1] + len(self.flat)])
        self.count = np.concatenate([self.count, np.diff(cut)])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids)."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        which: list[int] = []
        ends = []
        look = self.known.__getitem__
        for t in texts:
            which += map(look, self._keys(t))
            ends.append(len(which))
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            self._learn(fresh)
        w = np.array(which, np.int64)
        ids, n = gathered(self.flat, self.begin[w], self.count[w])
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(np.concatenate([[0], upto[np.array(ends, np.int64)]]))

    def _keys(self, text: str) -> list[str]:
        """Cache keys of a text's pieces: a word that follows a space stands for
        itself, any other piece has one NUL before it, a special token two."""
        if self.cut and self.cut.search(text):
            keys = []
            for k, part in enumerate(self.cut.split(text)):
                keys += ["\0\0" + part] if k % 2 else self._keys(part)
            return keys
        if "\0" in text or _WIDE.search(text):
            return ["\0" + p for p in _PIECES.findall(text)]
        return ("\0" + text.replace("\n", " \0\n \0")).split(" ")

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        lens = self.token_len[ids]
        upto = np.concatenate([[0], np.cumsum(lens)])
        raw = gathered(self.token_bytes, self.token_stop[ids] - lens, lens)[0].tobytes()
        stop = np.concatenate([[0], np.cumsum(counts)])
        cut = upto[stop]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


def slices(texts: list[str], most: int = SLICE_CHARS):
    """Index ranges of about ``most`` characters each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def bpe_round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every document."""
    spark = docs.sparkSession
    C.prepare(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches):
        enc = C.worker_slot(("bpe", spec.value), lambda: Encoder(spec.value))
        for b in batches:
            ids_col = b.column("doc_id")
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in slices(texts):
                ids, counts = enc.encode(texts[lo:hi])
                raw = ids.astype("<u4").tobytes()
                stop = 4 * np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [ids_col.slice(lo, hi - lo), pa.array([raw[a:z] for a, z in zip(stop[:-1], stop[1:])], pa.binary()),
                     pa.array(enc.decode(ids, counts), pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids binary, decoded string")
