"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` where it is not yet. Without that setting a
    local session gets a temporary folder; on a cluster it is an error, as executors share no temporary folder."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read from there: later steps neither repeat the work nor depend on
    the executors that did it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def with_summary(rows: DataFrame, summary: DataFrame, key: str, summary_key: str) -> DataFrame:
    """Inner join of many rows to one row per key. The second equality keeps Spark from reusing the summary's own
    partitioning, so that AQE can split the partition of a hot key."""
    same: Column = (rows[key] == summary[summary_key]) & (F.xxhash64(rows[key]) == F.xxhash64(summary[summary_key]))
    return rows.join(summary, same)


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return with_summary(both, least, "u", "_u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
    own = least.select(F.col("_u").alias("a"), F.col("m").alias("b"))
    others = with_summary(down, least, "u", "_u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return own.unionByName(others).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): of every node that has a link, the smallest node it can reach. Links are undirected; null ends
    and links of a node to itself are left out.

    Large-star hangs the larger neighbours of each node on its smallest one, small-star the smaller ones; both keep the
    components and never add links. When nothing changes, every node hangs on the smallest of its component.
    """
    edges = saved(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct())
    before = _sum(edges)
    while before[0]:
        edges = saved(_small_star(_large_star(edges)))
        now = _sum(edges)
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
