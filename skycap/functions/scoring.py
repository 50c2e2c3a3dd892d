"""Relevance and probability scoring (m01-m06).

Column versions serve row-wise use (joins on a bounded candidate list, such
as zero-shot candidates).  The numpy versions are the same formulas for the
blocked all-pairs kernel, which never materialises pairs as rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference for identical scores)
# ---------------------------------------------------------------------------
TEMP_TOLERANCE = 5.0
W_REGION, W_SEASON, W_TEMPERATURE, W_CONDITIONS = 0.8, 0.6, 0.7, 0.5
MAX_TOTAL_WEIGHT = 2.6                        # sum of the four active weights
SEASON_ORDER = ["winter", "spring", "summer", "fall"]   # circular; autumn == fall
DEFAULT_LOGIT_SCALE = math.log(1 / 0.07)
# ---------------------------------------------------------------------------
DEFAULT_SCALE = 1 / 0.07                      # exp(DEFAULT_LOGIT_SCALE)
UNKNOWN = "Unknown"


class Weights(NamedTuple):
    """Weights of the parts of a relevance, and the temperature difference at which its part is 0."""

    region: float = W_REGION
    season: float = W_SEASON
    temperature: float = W_TEMPERATURE
    conditions: float = W_CONDITIONS
    tolerance: float = TEMP_TOLERANCE

    @property
    def total(self) -> float:
        return round(self.region + self.season + self.temperature + self.conditions, 12)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season_index(season) -> Column:
    """Index of the last word in the circular season order; NULL if none."""
    s = F.replace(_c(season), F.lit("autumn"), F.lit("fall"))
    last = F.element_at(F.split(F.trim(s), r"\s+"), -1)
    pos = F.array_position(F.array(*[F.lit(x) for x in SEASON_ORDER]), last)
    return F.when(pos > 0, (pos - 1).cast("int"))


def season_similarity(s1, s2) -> Column:                    # m01
    a, b = _c(s1), _c(s2)
    i, j = season_index(a), season_index(b)
    d = F.abs(i - j)
    d = F.least(d, F.lit(4) - d)
    by_index = F.when(d == 0, 1.0).when(d == 1, 0.5).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).when(i.isNull() | j.isNull(), F.lit(0.0)).otherwise(by_index)


def temperature_similarity(t1, t2, tolerance: float = TEMP_TOLERANCE) -> Column:               # m02
    d = F.abs(_c(t1) - _c(t2))
    near = F.lit(1.0) - d / F.lit(float(tolerance)) if tolerance > 0 else F.lit(1.0)
    return F.when(d <= tolerance, near).otherwise(F.lit(0.0))


def weather_similarity(r1, r2, weights: Weights = Weights()) -> Column:                   # m03
    """Relevance of two parsed captions (structs from ``parse_caption``); 0 where all weights are 0
    and the captions differ."""
    a, b = _c(r1), _c(r2)
    known = lambda f: (a[f] != UNKNOWN) & (b[f] != UNKNOWN)
    reg = F.when(known("region"), F.when(a["region"] == b["region"], float(weights.region)).otherwise(0.0)).otherwise(0.0)
    sea = F.when(known("season"), season_similarity(a["season"], b["season"]) * float(weights.season)).otherwise(0.0)
    tmp = F.when(a["avg_temperature"].isNotNull() & b["avg_temperature"].isNotNull(),
                 temperature_similarity(a["avg_temperature"], b["avg_temperature"], weights.tolerance) * float(weights.temperature)).otherwise(0.0)
    con = F.when(known("conditions"), F.when(a["conditions"] == b["conditions"], float(weights.conditions)).otherwise(0.0)).otherwise(0.0)
    score = (((F.lit(0.0) + reg) + sea) + tmp) + con
    part = score / F.lit(weights.total) if weights.total > 0 else F.lit(0.0)
    return F.when(a["raw_caption"] == b["raw_caption"], F.lit(1.0)).otherwise(part)


def dot(a, b) -> Column:                                    # m04
    """Dot product of two numeric arrays, accumulated in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def sigmoid_probability(cos, scale: float = DEFAULT_SCALE) -> Column:  # m05
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(scale) * _c(cos)))


# --- numpy twins for the blocked kernel -------------------------------------
def np_relevance(q: dict, c: dict, weights: Weights = Weights()) -> np.ndarray:
    """Relevance matrix [len(q), len(c)] from encoded parse features.

    Feature dict keys: ``region``/``conditions``/``caption`` integer codes
    (-1 = Unknown), ``season`` index (-1 = Unknown), ``temp`` float (NaN =
    missing), ``id`` sample ids."""
    score = np_score(q, c, weights)
    rel = score / weights.total if weights.total > 0 else 0.0 * score
    same = (q["caption"][:, None] == c["caption"][None, :]) | (q["id"][:, None] == c["id"][None, :])
    return np.where(same, 1.0, rel)


def np_score(q: dict, c: dict, weights: Weights = Weights()) -> np.ndarray:
    """The weighted sum of the parts of ``np_relevance``."""
    def known(x, y):
        return (x[:, None] >= 0) & (y[None, :] >= 0)

    reg = np.where(known(q["region"], c["region"]) & (q["region"][:, None] == c["region"][None, :]), weights.region, 0.0)
    d = np.abs(q["season"][:, None] - c["season"][None, :])
    d = np.minimum(d, 4 - d)
    ssim = np.where(d == 0, 1.0, np.where(d == 1, 0.5, 0.0))
    sea = np.where(known(q["season"], c["season"]), ssim * weights.season, 0.0)
    td = np.abs(q["temp"][:, None] - c["temp"][None, :])
    tsim = np.where(td <= weights.tolerance, 1.0 - td / weights.tolerance if weights.tolerance > 0 else 1.0, 0.0)
    tmp = np.where(np.isnan(td), 0.0, tsim * weights.temperature)
    con = np.where(known(q["conditions"], c["conditions"]) & (q["conditions"][:, None] == c["conditions"][None, :]),
                   weights.conditions, 0.0)
    return (((0.0 + reg) + sea) + tmp) + con


def np_softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def np_contrastive_loss(logits: np.ndarray) -> float:       # m06
    """BCE-with-logits against the identity, ``pos_weight = B - 1``, mean over
    B*B; both directions are transposes with a constant weight, so equal."""
    b = logits.shape[0]
    eye = np.eye(b, dtype=bool)
    loss = np.where(eye, (b - 1.0) * np_softplus(-logits), np_softplus(logits))
    return float(loss.mean())
