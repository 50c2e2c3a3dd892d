"""Blocked all-pairs evaluation without materialising pairs.

Queries and candidates are hash-assigned to blocks of at most about
``block_rows`` rows.  Each (query block, candidate block) pair becomes one
cogroup; a numpy kernel scores the block pair inside the task and emits only
per-query partial aggregates (counts, best hits, top-k lists).  Spark then
merges the partials per query with ordinary aggregates.

* Memory per task is bounded by ``block_rows`` on each side, whatever the
  data size; no n*n rows are ever shuffled or stored.
* Shuffle volume is about ``n * (Q + C)`` vectors for Q query and C candidate
  blocks, i.e. O(n^2 / block_rows): raise ``block_rows`` to trade memory
  for shuffle.
* Blocks come from a hash of the id, so a skewed label or region cannot
  concentrate rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.session import ship_package


def n_blocks(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / block_rows))


MAX_BLOCK_ROWS = 4096
MIN_BLOCK_ROWS = 128
#: The same for kernels that score a block pair tile by tile, ``TILE`` rows a side: fewer blocks, less shuffle.
TILED_BLOCK_ROWS = 16384
TILE = 1024


def auto_block_rows(n_rows: int, parallelism: int, most: int = MAX_BLOCK_ROWS) -> int:
    """Block size giving at least ~2 block pairs per core (so small inputs
    still use the whole cluster), capped so one task's working set stays
    bounded (``most`` rows a side) whatever the data size."""
    per_side = max(1, math.ceil(math.sqrt(2 * max(1, parallelism))))
    return int(min(most, max(MIN_BLOCK_ROWS, math.ceil(n_rows / per_side))))


def block_pairs(queries: DataFrame, cands: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                schema: str, *, block_rows: int | None = None, q_rows: int | None = None, c_rows: int | None = None,
                seed: int = 17) -> DataFrame:
    """Run ``kernel(query_block_pdf, cand_block_pdf) -> partials_pdf`` on every
    block pair.  ``queries`` needs ``qid``; ``cands`` needs ``cid``.  Row
    counts may be passed to avoid the two (cheap, distributed) counts.
    ``block_rows=None`` sizes blocks from the data and the parallelism."""
    ship_package(queries.sparkSession)
    qn = q_rows if q_rows is not None else queries.count()
    cn = c_rows if c_rows is not None else cands.count()
    if block_rows is None:
        block_rows = auto_block_rows(max(qn, cn), queries.sparkSession.sparkContext.defaultParallelism)
    Q, C = n_blocks(qn, block_rows), n_blocks(cn, block_rows)
    q = (queries.withColumn("qblk", F.pmod(F.xxhash64("qid", F.lit(seed)), F.lit(Q)).cast("int"))
         .withColumn("cblk", F.explode(F.sequence(F.lit(0), F.lit(C - 1)))))
    c = (cands.withColumn("cblk", F.pmod(F.xxhash64("cid", F.lit(seed + 1)), F.lit(C)).cast("int"))
         .withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(Q - 1)))))

    def run(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame()
        return kernel(qpdf, cpdf)

    return q.groupBy("qblk", "cblk").cogroup(c.groupBy("qblk", "cblk")).applyInPandas(run, schema)


def stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()])
