"""Byte-level BPE encoding and decoding with the tiktoken library.

A local rank file (base64 token and rank a line) and a pattern make the encoding.
Each Python worker builds it once.  A text of over ``BLOCK_CHARS`` characters is
cut at *safe boundaries*, where a match of the pattern ends whatever follows:
between a character that is no white space and a space or line break, and between
a letter of a common script and a digit or a mark.  What still has no boundary for
more than ``WHOLE_CHARS`` (one endless run of a kind, which overflows the
library's pattern search) is cut into the pattern's matches by the regex module,
and the library merges each match.  Decoding joins the tokens' raw bytes, with no
detour by text.

Defined results: a null or empty text has no ids and decodes to no bytes; strings
that name special tokens are ordinary text; repeated rows and rows without an id
are encoded row by row; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.llm import common as C

BLOCK_CHARS = 1 << 15
WHOLE_CHARS = 1 << 16

#: White space of Unicode; no later version adds any.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and marks that every version of Unicode in use classes alike.
_LETTER = "A-Za-zа-яぁ-ゖァ-ヺ一-龥가-힣"
_SAFE = regex.compile(f"(?<=[^{_WS}])[ \n\r\t]|(?<=[{_LETTER}])[0-9!-/:-@、。！，？]")


def blocks(text: str, size: int = BLOCK_CHARS):
    """Stretches of at least ``size`` characters (but the last) cut at safe boundaries."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


class Codec:
    """Encoding and decoding by one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        of = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, ranks.splitlines()))}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=of, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str, block: int = BLOCK_CHARS, whole: int = WHOLE_CHARS) -> np.ndarray:
        parts = [self._block(b, whole) for b in blocks(text, block)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _block(self, text: str, whole: int) -> np.ndarray:
        if len(text) <= whole:
            return self.library.encode_to_numpy(text, disallowed_special=())
        one = self.library._encode_single_piece
        return np.concatenate([np.array(one(m.group()), np.uint32) for m in self.pattern.finditer(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())


def rank_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every document."""
    import public_tokenizers

    spark = docs.sparkSession
    C.prepare(spark)
    pattern = pattern or public_tokenizers.PATTERN
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary: does not grow with the data

    def run(batches):
        codec = C.worker_slot(("ranks", ranks.value, pattern), lambda: Codec(ranks.value, pattern))
        for b in batches:
            column = b.column("text")
            for lo, hi in C.slices(column, 1 << 20):
                ids = [codec.encode(t or "") for t in column.slice(lo, hi - lo).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int64)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(ends.astype(np.int32), flat),
                     pa.array(map(codec.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded binary")
