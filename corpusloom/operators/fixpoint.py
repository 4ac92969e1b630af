"""What is reached step by step: rows reachable along links, and components of links, each step a join.

A step's rows are written by checkpoint(), so that a lost executor costs no earlier step;
the folder is the session's spark.checkpoint.dir.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of its own only where all runs in one process and none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def reachable(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(start, node): nodes that links (a, b) lead to from each start (node), itself included. Each step joins only what is new."""
    every = kept(starts.select(F.col("node").alias("start"), "node").distinct())
    fresh = every
    while True:
        found = fresh.join(links.select(F.col("a").alias("node"), "b"), "node").select("start", F.col("b").alias("node")).distinct()
        fresh = kept(found.join(every, ["start", "node"], "left_anti"))
        if fresh.isEmpty():
            return every
        every = kept(every.unionByName(fresh))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of nodes in links (a, b): the smallest node reachable, by taking the least neighbour's component and that one's own in turn."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    own = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(own.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        jump = own.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        after = own.join(near, "node").join(jump, "component", "left").select("node", F.col("component").alias("was"), F.least("component", "least", "onward").alias("component"))
        after = kept(after)
        if after.where("component < was").isEmpty():
            return after.select("node", "component")
        own = after.select("node", "component")
