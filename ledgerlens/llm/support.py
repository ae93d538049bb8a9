"""What the operators share: table access, intermediate tables in the shared folder, components of a graph."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies at the same path; elsewhere ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if driver and executors are one
    process, as in tests; on a cluster an error, as executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="llm-shared-"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back: later jobs start from files
    that survive a lost executor, and its work is not repeated by each of them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (node, root), root being the smallest node.

    Alternating large-star and small-star steps: each node hangs its larger, then its smaller neighbours
    on the smallest node it knows, until nothing moves. Minima are combined before the shuffle, so a hub
    is no large group; the joins that read neighbours can be split by adaptive execution. Each round is
    written to the shared folder. Nulls and loops are ignored; no edges give no rows."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = settle(ordered, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m"))
        now = settle(small.distinct(), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
