"""Dependants to any depth: what a set of roots reaches over parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import shared_dir


def reachable(edges: DataFrame, roots: DataFrame, parent: str, child: str, root: str, depth_col: str = "depth",
              max_depth: int | None = None) -> DataFrame:
    """``child`` and its least depth for everything that the ``root`` column of
    ``roots`` reaches over ``edges`` (the roots themselves have depth 0).

    Breadth first: each round joins only the rows found by the last one with
    the edges and drops what is known, so cycles end and a node reached on
    several ways appears once. Rounds are written to the shared folder: the
    plan stays short, and an executor lost in round 20 does not repeat the 19
    before. NULL nodes reach nothing and are not reached."""
    spark = edges.sparkSession
    folder = shared_dir(spark, "reach")
    links = (edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).filter("p IS NOT NULL AND c IS NOT NULL AND p <> c").distinct())
    front = roots.select(F.col(root).alias("c")).filter("c IS NOT NULL").distinct()
    depth = 0
    while True:
        front.withColumn("d", F.lit(depth)).write.parquet(f"{folder}/round={depth}")
        front = spark.read.parquet(f"{folder}/round={depth}").select("c")
        if max_depth is not None and depth >= max_depth or front.isEmpty():
            break
        known = spark.read.parquet(*[f"{folder}/round={k}" for k in range(depth + 1)]).select("c")
        front = (links.join(front.withColumnRenamed("c", "p"), "p", "left_semi").select("c").distinct()
                 .join(known, "c", "left_anti"))
        depth += 1
    found = spark.read.parquet(*[f"{folder}/round={k}" for k in range(depth + 1)])
    return found.select(F.col("c").alias(child), F.col("d").alias(depth_col))
