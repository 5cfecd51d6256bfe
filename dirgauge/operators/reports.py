"""The reports as DataFrame operators over nodes (see sources): summaries, small files, usage, paths, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirgauge.functions.columns import INITIAL_BUCKETS, BucketModel, ancestors_or_self, symbolic_mode, type_char
from dirgauge.plans.tree import in_subtree

SMALL = 2 * 1048576


def _count(kind: str) -> Column:
    return F.sum(F.when(F.col("type") == kind, 1).otherwise(0)).cast("long")


def _totals() -> list[Column]:
    return [_count("FILE").alias("files"), _count("DIRECTORY").alias("dirs"), _count("SYMLINK").alias("links"), F.sum("n_blocks").cast("long").alias("blocks"), F.sum("size").cast("long").alias("size"), F.sum("consumed").cast("long").alias("consumed")]


def subtree(nodes: DataFrame, start: str) -> DataFrame:
    return nodes.where(in_subtree(F.col("path"), start))


def summary(nodes: DataFrame, by: str | None = None) -> DataFrame:
    """Totals overall, or by owner or grp."""
    return nodes.groupBy(*([by] if by else [])).agg(*_totals())


def summary_grouping_sets(nodes: DataFrame) -> DataFrame:
    """The three levels in one pass: level, name, totals."""
    out = nodes.groupingSets([[], ["grp"], ["owner"]], "grp", "owner").agg(F.grouping("grp").alias("_g"), F.grouping("owner").alias("_o"), *_totals())
    level = F.when(F.col("_g") == 0, "group").when(F.col("_o") == 0, "user").otherwise("overall")
    return out.select(level.alias("level"), F.coalesce("grp", "owner", F.lit("/")).alias("name"), "files", "dirs", "links", "blocks", "size", "consumed")


def statistics(nodes: DataFrame) -> DataFrame:
    """level (overall, group, user), name, totals and buckets, an array of counts that is as long for all: all levels in one pass.

    Null owners and groups are levels of their own, named by an empty text.
    """
    top = nodes.agg(F.max("bucket")).first()[0]
    length = max(INITIAL_BUCKETS, (top or 0) + 1)
    count = lambda k: F.sum(F.when(F.col("bucket") == k, 1).otherwise(0)).cast("long")
    keyed = nodes.withColumns({"owner": F.coalesce("owner", F.lit("")), "grp": F.coalesce("grp", F.lit(""))})
    out = keyed.groupingSets([[], ["grp"], ["owner"]], "grp", "owner").agg(F.grouping("grp").alias("_g"), F.grouping("owner").alias("_o"), *_totals(), F.array(*map(count, range(length))).alias("buckets"))
    level = F.when(F.col("_g") == 0, "group").when(F.col("_o") == 0, "user").otherwise("overall")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(level.alias("level"), F.coalesce("grp", "owner", F.lit("/")).alias("name"), *map(zero, ("files", "dirs", "links", "blocks", "size", "consumed")), "buckets")


def histogram(nodes: DataFrame, by: str | None = None, model: BucketModel | None = None) -> DataFrame:
    """Files per size bucket; overall dense from 0 to the highest filled. model: other buckets than the nodes' own."""
    files = nodes.where("type = 'FILE'")
    counts = (files if model is None else files.withColumn("bucket", model.bucket(F.col("size")))).groupBy(*([by] if by else []), "bucket").agg(F.count(F.lit(1)).alias("files"))
    if by:
        return counts
    dense = counts.agg(F.max("bucket").alias("top")).select(F.explode(F.sequence(F.lit(0), "top")).alias("bucket"))
    return dense.join(counts, "bucket", "left").select("bucket", F.coalesce("files", F.lit(0)).alias("files"))


def small_files(nodes: DataFrame, limit: int = SMALL, user: str | None = None) -> DataFrame:
    """Files strictly below limit; user: a pattern that the whole owner matches."""
    out = nodes.where((F.col("type") == "FILE") & (F.col("size") < limit))
    return out.where(F.col("owner").rlike(rf"\A(?:{user})\z")) if user else out


def roll_up(by_dir: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each directory's value added to itself and all its ancestors up to /."""
    return by_dir.withColumn("path", F.explode(ancestors_or_self(F.col("parent_path")))).groupBy(*keys, "path").agg(F.sum(value).cast("long").alias(value))


def top_per_key(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The n largest of each key, ties by path."""
    order = Window.partitionBy(key).orderBy(F.col(value).desc(), "path")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def user_usage(nodes: DataFrame, user: str, before_ms: int | None = None) -> DataFrame:
    """Bytes of a user's files by directory; user whatever its case, files last changed before a time."""
    out = nodes.where((F.col("type") == "FILE") & (F.lower("owner") == user.lower()))
    if before_ms is not None:
        out = out.where(F.col("mtime_ms") < before_ms)
    return out.groupBy("parent_path").agg(F.sum("size").cast("long").alias("size"))


def paths(nodes: DataFrame, starts: tuple[str, ...] = ("/",), user: str | None = None) -> DataFrame:
    """Nodes under any of starts, once each (a path is there once, and starts that overlap are one condition); user: a pattern that the whole owner matches."""
    seen = F.lit(False)
    for s in starts:
        seen = seen | in_subtree(F.col("path"), s)
    out = nodes.where(seen)
    if user:
        out = out.where(F.col("owner").rlike(rf"\A(?:{user})\z"))
    return out


def path_rows(nodes: DataFrame) -> DataFrame:
    permission = F.concat_ws(":", "owner", "grp", symbolic_mode(F.col("mode")))
    return nodes.select("path", type_char(F.col("type")).alias("type"), permission.alias("permission"))


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("parent_path") == path) & (F.col("path") != "/"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """Children of every node, 0 for leaves."""
    counts = nodes.where("path <> '/'").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.select("id", "path").join(counts, "id", "left").select("id", "path", F.coalesce("n_children", F.lit(0)).alias("n_children"))
