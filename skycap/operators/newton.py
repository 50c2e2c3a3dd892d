"""L2 logistic regression of many overlapping subsets in common Newton steps (ml08, ml09).

Cross-validation fits one model per fold on the rows outside it.  Here all
models advance together: one aggregate per step reads the rows once and emits,
for each model, its loss, gradient and Hessian at the model's own coefficients.
A task holds ``models x (d + 1)^2`` numbers whatever its rows; they are summed
by ``Summarizer`` with map-side combination, and the driver receives one sum
per model and coefficient.  The objective is that of ``fit_logistic``:
``0.5 |w|^2 + C * sum_i s_i * logloss_i`` with balanced weights s and a free
intercept.  A step that raises a model's loss is halved until it does not.

Width: the driver solves one system of d + 1 unknowns per model; d is the
number of features, which does not grow with the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.session import ensure_checkpoint_dir, ship_package

#: Rows of one batch of the kernel.
BATCH = 4096


def _sums(rows: DataFrame, state: dict[int, np.ndarray], weights: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
    """One pass: per model an array of d + 2 rows: d + 1 Hessian rows, then the gradient, each with the loss behind."""

    def kernel(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at:at + BATCH]
                X = np.column_stack([np.stack(part["x"].to_numpy()).astype(float), np.ones(len(part))])
                y, fold = part["y"].to_numpy(), part["fold"].to_numpy()
                for m, beta in state.items():
                    mine = fold != m
                    if not mine.any():
                        continue
                    Z, t = X[mine], y[mine]
                    s = np.where(t == 1, weights[m][1], weights[m][0])
                    eta = Z @ beta
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    got = np.zeros((Z.shape[1] + 1, Z.shape[1] + 1))
                    got[:-1, :-1] = (Z * (s * p * (1 - p))[:, None]).T @ Z
                    got[-1, :-1] = Z.T @ (s * (p - t))
                    got[-1, -1] = (s * (np.logaddexp(0, eta) - t * eta)).sum()
                    total[m] = total[m] + got if m in total else got
        for m, got in total.items():
            yield pd.DataFrame({"model": m, "i": range(len(got)), "row": list(got)})

    parts = rows.mapInPandas(kernel, "model int, i int, row array<double>")
    summed = parts.groupBy("model", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():  # (d + 2) rows per model, whatever the table
        out.setdefault(r["model"], np.zeros((len(r["row"]), len(r["row"]))))[r["i"]] = r["row"]
    return out


def fit_folds(df: DataFrame, models: list[int], *, C: float = 1.0, features: str = "scaled", label: str = "label",
              fold: str = "fold", max_iter: int = 100, tol: float = 1e-10) -> tuple[dict[int, np.ndarray], int]:
    """Coefficients (intercept last) of each model m, fitted on the rows whose ``fold`` is not m, and the number of
    passes over the rows.  A model number that no row has as its fold (such as -1) takes all rows.  A model without
    rows has no coefficients; one that sees a single class gets that class's weight for all its rows.  Rows with a
    null label, fold or feature vector, or with null components, are left out."""
    ship_package(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"),
                     F.col(fold).cast("int").alias("fold"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("fold").isNotNull()
                      & ~F.exists("x", lambda x: x.isNull())).checkpoint(eager=True)
    counts = rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).collect()
    weights, width = {}, max((r["d"] for r in counts), default=0)
    for m in models:
        by = {c: sum(r["n"] for r in counts if r["fold"] != m and (r["y"] == 1) == bool(c)) for c in (0, 1)}
        n, classes = sum(by.values()), sum(v > 0 for v in by.values())
        if n:
            weights[m] = tuple(n / (classes * by[c]) if by[c] else 0.0 for c in (0, 1))
    ridge = np.r_[np.ones(width) / C, 0.0]
    best = {m: np.zeros(width + 1) for m in weights}  # accepted coefficients
    step = {m: np.zeros(width + 1) for m in weights}
    loss = {m: np.inf for m in weights}
    active, passes = set(weights), 0
    while active and passes < max_iter:
        trial = {m: best[m] + step[m] for m in active}
        sums = _sums(rows, trial, weights)
        passes += 1
        for m in list(active):
            got, beta = sums[m], trial[m]
            now = got[-1, -1] + 0.5 * (ridge * beta * beta).sum()
            if now > loss[m] + 1e-12 * abs(loss[m]):
                step[m] = step[m] / 2
                if np.abs(step[m]).max() <= tol:
                    active.discard(m)
                continue
            best[m], loss[m] = beta, now
            gradient = got[-1, :-1] + ridge * beta
            hessian = got[:-1, :-1] + np.diag(ridge)
            step[m] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            if np.abs(step[m]).max() <= tol * max(1.0, np.abs(beta).max()):
                active.discard(m)
    return best, passes


def predict_folds(df: DataFrame, coefficients: dict[int, np.ndarray], *, features: str = "scaled", fold: str = "fold") -> DataFrame:
    """df with predicted_probability and predicted_label by the model of the row's own fold (null without one);
    the coefficients are a constant of one array per model."""
    table = F.create_map(*[x for m, beta in coefficients.items()
                           for x in (F.lit(m), F.array(*[F.lit(float(b)) for b in beta]))]) if coefficients else F.lit(None).cast("map<int,array<double>>")
    eta = F.aggregate(F.zip_with(F.concat(F.col(features).cast("array<double>"), F.array(F.lit(1.0))), F.try_element_at(table, F.col(fold)),
                                 lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    return df.withColumn("predicted_probability", p).withColumn("predicted_label", (F.col("predicted_probability") > 0.5).cast("int"))
