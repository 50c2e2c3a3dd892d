import random
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
for p in (str(ROOT), str(Path(__file__).parent)):
    if p not in sys.path:
        sys.path.insert(0, p)


def edge_texts():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, base = prose(60), prose(120)
    near = base.split()
    near[7] = "changed"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "one two three"), (6, "One TWO three"),
        (7, prose(20) + " " + passage + " " + prose(30)), (8, passage + "\n" + prose(10)), (9, prose(34) + "\n\n" + passage),
        (10, base), (11, " ".join(near)), (12, base), (12, base), (13, base.upper()),
        (14, "x y " * 200), (15, "é ü 日本語 🎉 " * 30), (16, "nul \0 here\0"), (17, "a" * 3000), (18, "ab" * 1500),
        (19, prose(3000)), (20, "mail a.b@c-d.org and x@y.z_q@r.st ip 10.0.0.1 1.2.3.4.5 999.1.1.1 card 4111 1111 1111 1111, +1 (319) 555-5132"),
        (21, "\n".join(["same line here"] * 5 + ["other"])), (22, "#### $$$ %%% && || <> ** "), (23, "<|endoftext|> it's   <|endoftext|>\r\n "),
        (None, "a document without an id " * 3), (24, "x" * 70 + " " + "é" * 90), (25, prose(4)), (26, "5--5 12 34 378282246310005 +12+1234567890"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Odd rows, with columns named as the operators name their own."""
    rows = [(i, t, "en", 1, 2, 3, "k", 0.5, 7) for i, t in edge_texts()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, chunk long, k1 long, node long, kept string, score double, n_words long")


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
