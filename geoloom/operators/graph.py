"""Distributed numbering and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with consecutive numbers from 0 in the given order: sorted ranges, numbered within, shifted by their sizes."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    local = materialise(parts.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1))
    sizes = sorted(local.groupBy("_part").count().collect())  # a row for each partition
    shift, total = [], 0
    for part, n in sizes:
        shift += [F.lit(part), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*shift), F.col("_part")) if shift else F.lit(0)
    return local.withColumn(name, (start + F.col("_n")).cast("long")).drop("_part", "_n")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct rows hold the same rows: every row of either is in the other."""
    return a.count() == b.count() and a.join(b, a.columns, "left_anti").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of undirected edges (a, b): alternating large and small stars."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    alone = pairs.filter("u = v").select("u", "v")
    edges, before = materialise(pairs.filter("u <> v").distinct()), None
    while before is None or not same_rows(before, edges):
        before = edges
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low)
        edges = materialise(small.distinct())
    rows = edges.union(edges.select("v", "v")).union(alone).toDF("node", "component")
    return rows.groupBy("node").agg(F.min("component").alias("component"))
