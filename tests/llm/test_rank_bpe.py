"""op11 against the library on whole texts, and its cuts against uncut texts."""

import base64
import random

import brute
import public_tokenizers
import pytest
import tiktoken

from skycap.llm import queries, rank_bpe


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return rank_bpe.Codec(f.read(), public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", ["edge", "small", "none"])
def test_equals_the_library(request, library, name):
    docs = request.getfixturevalue(name)
    got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in rank_bpe.rank_bpe(docs).collect()]
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    order = lambda x: (x[0] is None, x[0], x[2])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_query_digests(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_rank_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(docs[r.doc_id]))


def test_cuts_change_nothing(library, codec):
    """Random texts of awkward characters, cut as often as there are boundaries."""
    rnd = random.Random(3)
    alphabet = [*"ab'sre  \n\n\t1 2.,!-é", "あ", "中", "。", "　", "\x85", "\U0001f389", "'s", "don't", "'re", " ", "\x1c"]
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 120)))
        want = library.encode_ordinary(text)
        assert "".join(rank_bpe.blocks(text, 1)) == text
        assert codec.encode(text, block=1).tolist() == want
        assert codec.encode(text, block=3, whole=4).tolist() == want
        assert codec.decode(codec.encode(text, block=2)) == text.encode()


def test_endless_runs(codec):
    """Runs beyond what the library's pattern search stands; their bytes come back."""
    for unit in (" ", "\n", "a", "!", "x y ", "中", "ab1"):
        text = "start " + unit * (600_000 // len(unit)) + " end"
        assert codec.decode(codec.encode(text)) == text.encode()
