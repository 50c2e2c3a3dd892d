"""Connected components of links, with hot nodes dealt to many tasks.

Rounds of least labels: every node takes the least label around it, then the label of
its label (pointer jumping), until nothing changes.  A hub, or the label of a giant
component, is the key of many rows on one side of a join and of one row on the other;
``salted_join`` lays that one row out ``SALTS`` times and spreads the many.  Least
labels are combined map-side.  Each round is written to the shared folder.

Joins of tables that grow with the data are merge joins by hint: Spark takes a table that
``explode`` made 32 times as large, or one that compresses well, for a small one and
would broadcast it through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycap.session import kept

SALTS = 32


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left.join(right, on, how), never by a broadcast."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """many.join(one, key), where ``one`` has a row a key and ``many`` may have a great
    share of its rows at one key; they spread by the column ``spread``."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    laid = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return merge_join(dealt, laid, [key, "_salt"], how).drop("_salt")


def connected_components(nodes: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(id, comp), comp the least id reachable from id over edges (src, dst).  Both are written tables."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    label = kept(nodes.select("id", F.col("id").alias("comp")))
    for _ in range(most):
        there = label.select(F.col("id").alias("dst"), F.col("comp").alias("c"))
        around = salted_join(both, there, "dst", "src").groupBy("src").agg(F.min("c").alias("c"))
        new = kept(merge_join(label, around.withColumnRenamed("src", "id"), "id", "left").select(
            "id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp")))
        above = new.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        jumped = kept(salted_join(new, above, "comp", "id", "left").select("id", "old", F.least("comp", "top").alias("comp")))
        label = jumped.select("id", "comp")
        if jumped.where("comp <> old").limit(1).count() == 0:
            return label
    raise RuntimeError("components did not settle")
