"""Places of nodes in the directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirgauge.functions.columns import child_path, file_replication, size_bucket
from dirgauge.plans.store import table


def directory_paths(dirs: DataFrame, root: int, max_depth: int = 1000) -> DataFrame:
    """dirs(id, parent_id, name) -> (id, path, depth) of all directories in reach of root.

    Each round doubles how far up a directory's path is known, so a tree of depth d takes
    log2(d) joins over directories. A directory with several parents has several paths;
    one that root doesn't reach has none. Deeper trees than max_depth (and cycles) raise.
    """
    up = table(dirs.where(F.col("id") != root).select("id", F.col("parent_id").alias("top"), F.col("name").alias("below"), F.lit(1).alias("depth")))
    reach = 1
    while not (open_ := up.where(F.col("top") != root)).isEmpty():
        if reach > max_depth:
            raise ValueError(f"Directories are deeper than {max_depth} levels, or a cycle")
        above = up.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("below").alias("over"), F.col("depth").alias("more"))
        longer = open_.join(above, "top").select("id", F.col("next").alias("top"), F.concat("over", F.lit("/"), "below").alias("below"), (F.col("depth") + F.col("more")).alias("depth"))
        up = table(up.where(F.col("top") == root).unionByName(longer))
        reach *= 2
    top = dirs.where(F.col("id") == root).select("id", F.lit("/").alias("path"), F.lit(0).alias("depth"))
    return top.unionByName(up.select("id", F.concat(F.lit("/"), "below").alias("path"), "depth"))


def parents(paths: DataFrame) -> DataFrame:
    """directory_paths() as (parent_id, parent_path), to join with what lies in the directories."""
    return paths.select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path"))


def name_places(inodes: DataFrame, root: int) -> DataFrame:
    """inodes, which have parent_path, with path, effective_replication and bucket; those without a parent_path are left out, but for root."""
    is_root = F.col("id") == root
    return inodes.where(is_root | F.col("parent_path").isNotNull()).withColumns({
        "path": F.when(is_root, F.lit("/")).otherwise(child_path(F.col("parent_path"), F.col("name"))),
        "effective_replication": file_replication(F.col("replication"), F.col("ec_policy_id")),
        "bucket": F.when(F.col("type") == "FILE", size_bucket(F.col("size"))),
    })


def place(inodes: DataFrame, root: int) -> DataFrame:
    """inodes with parent_path, path, effective_replication and bucket; each partition is sorted by path.

    inodes have a row for each parent of a node, with its size. Nodes that root doesn't
    reach are left out. Rows stay where the join with their directories put them: in
    sorted partitions, too, a reader skips the pages that hold no path of a subtree.
    """
    paths = directory_paths(inodes.where("type = 'DIRECTORY'").select("id", "parent_id", "name"), root)
    return name_places(inodes.join(parents(paths), "parent_id", "left"), root).sortWithinPartitions("path")


def in_subtree(path, start: str):
    """Whether a path is start or below it."""
    return F.lit(True) if start == "/" else (path == start) | path.startswith(start + "/")
