"""Batch embedding inference (ml11): ``mapInPandas`` with a user-supplied
encoder factory, built once per partition and applied to Arrow batches.
A deterministic hashing text encoder ships for tests; model weights are not
shipped."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skycap.session import ship_package

EncoderFactory = Callable[[], Callable[[pd.Series], np.ndarray]]
_TOKEN = re.compile(r"[a-z0-9]+")


def hashing_text_encoder(dim: int = 256) -> EncoderFactory:
    """Signed feature hashing of lower-cased word tokens, L2-normalised."""
    def factory():
        import xxhash

        def encode(texts: pd.Series) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for r, t in enumerate(texts.fillna("")):
                for tok in _TOKEN.findall(t.lower()):
                    h = xxhash.xxh64_intdigest(tok)
                    out[r, h % dim] += 1.0 if (h >> 63) & 1 else -1.0
            norms = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return out / norms
        return encode
    return factory


def embed_batch(df: DataFrame, text_col: str, factory: EncoderFactory, id_col: str = "sample_id",
                out_col: str = "embedding") -> DataFrame:
    """(id, embedding array<double>) for every row; the encoder is created once
    per partition, batches arrive through Arrow."""
    ship_package(df.sparkSession)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for pdf in batches:
            vecs = encode(pdf[text_col])
            yield pd.DataFrame({id_col: pdf[id_col], out_col: list(vecs)})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} string, {out_col} array<double>")
