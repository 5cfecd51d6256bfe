"""A synthetic namespace of any size: letters at the top, width directories below each, files in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirgauge.plans.store import table
from dirgauge.plans.tree import place

ROOT, LETTERS = 16385, 26


def _levels(depth: int, width: int) -> list[tuple[int, int]]:
    """(first id, directories) of each level below the root."""
    out, first, n = [], ROOT + 1, LETTERS
    for _ in range(depth):
        out.append((first, n))
        first, n = first + n, n * width
    return out


def inodes(spark: SparkSession, depth: int = 5, width: int = 2, per_dir: int = 260) -> DataFrame:
    """A root, LETTERS * (1 + width + ... + width^(depth - 1)) directories and per_dir empty files in each of those; id and parent_id by arithmetic."""
    levels = _levels(depth, width)
    make = lambda df, id_, parent, kind, name: df.select(id_.alias("id"), parent.cast("long").alias("parent_id"), F.lit(kind).alias("type"), name.alias("name"))
    k = F.col("id")
    out = make(spark.range(1), k + ROOT, F.lit(0), "DIRECTORY", F.lit(""))
    for level, (first, n) in enumerate(levels):
        above = F.lit(ROOT) if level == 0 else levels[level - 1][0] + F.floor(k / width)
        out = out.unionByName(make(spark.range(n), k + first, above, "DIRECTORY", F.chr(k % (width if level else LETTERS) + 97)))
    n_dirs = sum(n for _, n in levels)
    file = make(spark.range(n_dirs * per_dir), k + ROOT + 1 + n_dirs, ROOT + 1 + F.floor(k / per_dir), "FILE", F.concat(F.lit("file_"), (k % per_dir).cast("string"))) if per_dir else None
    out = out.unionByName(file) if file is not None else out
    zero, is_file = F.lit(0).cast("long"), F.col("type") == "FILE"
    return out.withColumns({
        "owner": F.lit("hdfs"), "grp": F.lit("supergroup"), "mode": F.when(is_file, 0o644).otherwise(0o755), "replication": F.when(is_file, 1),
        "ec_policy_id": F.lit(None).cast("int"), "mtime_ms": zero, "size": zero, "consumed": zero, "n_blocks": zero,
    })


def edges(spark: SparkSession, depth: int = 5, width: int = 2, per_dir: int = 260) -> DataFrame:
    """(parent_id, child_id) of all nodes but the root."""
    return inodes(spark, depth, width, per_dir).where(F.col("id") != ROOT).select("parent_id", F.col("id").alias("child_id"))


def nodes(spark: SparkSession, depth: int = 5, width: int = 2, per_dir: int = 260) -> DataFrame:
    """The namespace as reports take it."""
    return table(place(inodes(spark, depth, width, per_dir), ROOT))
