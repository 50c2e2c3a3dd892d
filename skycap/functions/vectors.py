"""Vector column helpers (p12, p13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L2_EPS = 1e-12  # torch.nn.functional.normalize default eps


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v) -> Column:                              # p13
    n = F.greatest(l2_norm(v), F.lit(L2_EPS))
    return F.transform(_c(v), lambda x: x.cast("double") / n)


def select_embedding(image, text, embedding_type: str = "combined") -> Column:  # p12
    if embedding_type == "image":
        return _c(image)
    if embedding_type == "text":
        return _c(text)
    if embedding_type == "combined":
        return F.concat(_c(image).cast("array<double>"), _c(text).cast("array<double>"))
    raise ValueError(f"Unknown embedding type '{embedding_type}'; use image, text or combined")


def shifted_mix(v, weight: float = 0.3) -> Column:
    """``v[j] + weight * v[(j+1) mod d]`` in double (text-side derivation)."""
    arr = _c(v)
    return F.transform(arr, lambda x, i: x.cast("double")
                       + F.lit(weight) * F.get(arr, (i + 1) % F.size(arr)).cast("double"))
