"""Queries of the namespace reports and the SQL that DuckDB checks them with."""

from __future__ import annotations

from pyspark.sql import functions as F

from dirgauge.functions import columns as C
from dirgauge.operators import lookups as L
from dirgauge.operators import reports as R
from dirgauge.plans.store import table
from dirgauge.render import text as T
from dirgauge.sources import image as I
from dirgauge.sources import tables as S

QUERIES: dict = {}
ORACLES: dict = {}

CUTOFF_MS = 883612800000  # 1998-01-01
NATION = "/ASIA"

#: The same nodes in DuckDB SQL.
NODES_SQL = """
WITH RECURSIVE base AS (
  SELECT 16385::BIGINT AS id, 0::BIGINT AS parent_id, 'DIRECTORY' AS type, '' AS name, 'hdfs' AS owner, 'supergroup' AS grp, 493 AS mode, NULL::INT AS replication, NULL::INT AS ec, 0::BIGINT AS mtime_ms
  UNION ALL SELECT 100000000 + r_regionkey, 16385, 'DIRECTORY', r_name, 'hdfs', 'supergroup', 493, NULL, NULL, 0 FROM region
  UNION ALL SELECT 200000000 + n_nationkey, 100000000 + n_regionkey, 'DIRECTORY', n_name, 'hdfs', 'supergroup', 493, NULL, NULL, 0 FROM nation
  UNION ALL SELECT 300000000 + c_custkey, 200000000 + c_nationkey, 'DIRECTORY', c_name, 'hdfs', c_mktsegment, 493, NULL, NULL, 0 FROM customer
  UNION ALL SELECT 400000000 + o_orderkey, 300000000 + o_custkey, 'FILE', 'order_' || o_orderkey, o_orderpriority, c_mktsegment, 420, 1 + o_orderkey % 3,
                   CASE o_orderkey % 10 WHEN 0 THEN 1 WHEN 5 THEN 2 END, epoch_ms(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 500000000 + s_suppkey, 200000000 + s_nationkey, 'SYMLINK', s_name, 'hdfs', 'supergroup', 511, NULL, NULL, 0 FROM supplier),
dpath AS (
  SELECT id, '/' AS path, 0 AS depth FROM base WHERE id = 16385
  UNION ALL SELECT b.id, CASE WHEN d.path = '/' THEN '/' ELSE d.path || '/' END || b.name, d.depth + 1 FROM dpath d JOIN base b ON b.parent_id = d.id WHERE b.type = 'DIRECTORY' AND b.id <> 16385),
blk AS (
  SELECT b.id, CAST(l_quantity * l_quantity * 4096 AS BIGINT) AS nb, b.replication AS rep, b.ec, CASE b.ec WHEN 1 THEN 6 WHEN 2 THEN 3 END AS du, CASE b.ec WHEN 1 THEN 3 WHEN 2 THEN 2 END AS pu
  FROM lineitem JOIN base b ON b.id = 400000000 + l_orderkey),
sums AS (
  SELECT id, sum(nb)::BIGINT AS size, count(*) AS n_blocks,
         sum(CASE WHEN ec IS NULL THEN nb * rep ELSE nb + CAST(ceil(ceil(nb / 1048576.0) / du) AS BIGINT) * pu * 1048576 END)::BIGINT AS consumed FROM blk GROUP BY id),
n0 AS (
  SELECT b.*, d.path AS parent_path, CASE WHEN b.id = 16385 THEN '/' WHEN d.path = '/' THEN '/' || b.name ELSE d.path || '/' || b.name END AS path,
         coalesce(s.size, 0) AS size, coalesce(s.consumed, 0) AS consumed, coalesce(s.n_blocks, 0) AS n_blocks
  FROM base b LEFT JOIN dpath d ON d.id = b.parent_id LEFT JOIN sums s ON s.id = b.id),
nodes AS (
  SELECT *, CASE WHEN type <> 'FILE' THEN NULL WHEN size = 0 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 2097152 THEN 2
                 ELSE CAST(floor(log2(size / 2097152.0) + 1e-12) AS INT) + 3 END AS bucket FROM n0),
small AS (SELECT * FROM nodes WHERE type = 'FILE' AND size < 2097152),
anc AS (
  SELECT d.path AS dir, '/' AS up FROM dpath d
  UNION SELECT d.path, '/' || array_to_string(string_split(substr(d.path, 2), '/')[1:k], '/') FROM dpath d, range(1, 40) t(k) WHERE d.path <> '/' AND k <= len(string_split(substr(d.path, 2), '/')))
"""
TOTALS = "sum((type='FILE')::INT)::BIGINT AS files, sum((type='DIRECTORY')::INT)::BIGINT AS dirs, sum((type='SYMLINK')::INT)::BIGINT AS links, sum(n_blocks)::BIGINT AS blocks, sum(size)::BIGINT AS size, sum(consumed)::BIGINT AS consumed"
SYMBOLIC = "CASE mode WHEN 493 THEN 'rwxr-xr-x' WHEN 420 THEN 'rw-r--r--' WHEN 511 THEN 'rwxrwxrwx' END"
OCTAL = "CASE mode WHEN 493 THEN '0755' WHEN 420 THEN '0644' WHEN 511 THEN '0777' END"


def _add(name: str, build, sql: str) -> None:
    """build takes the nodes; sql continues the common table expressions of NODES_SQL."""
    QUERIES[name] = lambda spark, sf_dir: build(S.nodes(spark, sf_dir))
    ORACLES[name] = f"{NODES_SQL} {sql}"


_add("summary_grouping_sets", R.summary_grouping_sets, f"SELECT CASE WHEN grouping(grp) = 0 THEN 'group' WHEN grouping(owner) = 0 THEN 'user' ELSE 'overall' END AS level, coalesce(grp, owner, '/') AS name, {TOTALS} FROM nodes GROUP BY GROUPING SETS ((), (grp), (owner))")
_add("summary_overall", R.summary, f"SELECT {TOTALS} FROM nodes")
_add("summary_by_group", lambda n: R.summary(n, "grp"), f"SELECT grp, {TOTALS} FROM nodes GROUP BY grp")
_add("summary_by_user", lambda n: R.summary(n, "owner"), f"SELECT owner, {TOTALS} FROM nodes GROUP BY owner")
_add("summary_distinct_principals", lambda n: n.agg(F.countDistinct("owner").alias("n_users"), F.countDistinct("grp").alias("n_groups")), "SELECT count(DISTINCT owner) AS n_users, count(DISTINCT grp) AS n_groups FROM nodes")
_add("summary_user_filter", lambda n: R.summary(n, "owner").where(F.col("owner").rlike("(?i)URG|dfs")), f"SELECT owner, {TOTALS} FROM nodes GROUP BY owner HAVING regexp_matches(owner, '(?i)URG|dfs')")
for _key, _metric in (("fs", "size"), ("fc", "files"), ("dc", "dirs"), ("bc", "blocks")):
    _add(f"summary_sorted_{_key}", lambda n, m=_metric: R.summary(n, "owner").orderBy(F.col(m).asc(), "owner"), f"SELECT owner, {TOTALS} FROM nodes GROUP BY owner ORDER BY {_metric}, owner")
_add("subtree_summary", lambda n: R.summary(R.subtree(n, NATION)), f"SELECT {TOTALS} FROM nodes WHERE path = '{NATION}' OR starts_with(path, '{NATION}/')")
_add("multi_dir_summary", lambda n: R.summary(R.subtree(n, "/ASIA")).withColumn("start_dir", F.lit("/ASIA")).unionByName(R.summary(R.subtree(n, "/EUROPE")).withColumn("start_dir", F.lit("/EUROPE"))), f"SELECT start_dir, {TOTALS} FROM nodes JOIN (VALUES ('/ASIA'), ('/EUROPE')) v(start_dir) ON path = start_dir OR starts_with(path, start_dir || '/') GROUP BY start_dir")


def _csv_rows(n):
    names = [(F.lit("Overall"), F.lit("/")), (F.lit("Group"), F.col("grp")), (F.lit("User"), F.col("owner"))]
    # the three levels of a row in one pass over the nodes
    levels = n.withColumn("at", F.explode(F.array(*[F.struct(a.alias("level"), b.alias("name")) for a, b in names])))
    buckets = [F.sum(F.when((F.col("type") == "FILE") & (F.col("bucket") == k), 1).otherwise(0)).cast("long").alias(f"bucket_{k}") for k in range(C.INITIAL_BUCKETS)]
    return levels.groupBy("at.level", "at.name").agg(F.sum((F.col("type") == "DIRECTORY").cast("int")).cast("long").alias("dirs"), F.sum((F.col("type") == "SYMLINK").cast("int")).cast("long").alias("links"), F.sum((F.col("type") == "FILE").cast("int")).cast("long").alias("files"), F.sum("size").cast("long").alias("size"), F.sum("n_blocks").cast("long").alias("blocks"), *buckets)


_add("summary_csv_rows", _csv_rows, "SELECT level, name, sum((type='DIRECTORY')::INT)::BIGINT AS dirs, sum((type='SYMLINK')::INT)::BIGINT AS links, sum((type='FILE')::INT)::BIGINT AS files, sum(size)::BIGINT AS size, sum(n_blocks)::BIGINT AS blocks, " + ", ".join(f"sum((bucket IS NOT NULL AND bucket = {k})::INT)::BIGINT AS bucket_{k}" for k in range(18)) + " FROM (SELECT *, 'Overall' AS level, '/' AS lname FROM nodes UNION ALL SELECT *, 'Group', grp FROM nodes UNION ALL SELECT *, 'User', owner FROM nodes) t(id, parent_id, type, name0, owner, grp, mode, replication, ec, mtime_ms, parent_path, path, size, consumed, n_blocks, bucket, level, name) GROUP BY level, name")
_add("size_bucket", lambda n: n.where("type = 'FILE'").select("id", "size", "bucket"), "SELECT id, size, bucket FROM nodes WHERE type = 'FILE'")
_add("size_histogram", R.histogram, "SELECT k::INT AS bucket, (SELECT count(*) FROM nodes WHERE bucket = k) AS files FROM range(0, (SELECT max(bucket) + 1 FROM nodes)) t(k)")
_add("size_histogram_by_user", lambda n: R.histogram(n, "owner"), "SELECT owner, bucket, count(*) AS files FROM nodes WHERE type = 'FILE' GROUP BY ALL")
_add("size_histogram_by_group", lambda n: R.histogram(n, "grp"), "SELECT grp, bucket, count(*) AS files FROM nodes WHERE type = 'FILE' GROUP BY ALL")
_add("histogram_stats", lambda n: R.histogram(n).agg(F.max("bucket").alias("top_bucket"), F.max("files").alias("most_files"), F.count(F.lit(1)).alias("n_buckets")), "SELECT max(bucket) AS top_bucket, max(c)::BIGINT AS most_files, max(bucket)::BIGINT + 1 AS n_buckets FROM (SELECT bucket, count(*) AS c FROM nodes WHERE type = 'FILE' GROUP BY bucket)")
_add("bucket_borders", lambda n: R.histogram(n).select("bucket", C.bucket_border(F.col("bucket")).alias("border")), "SELECT k::INT AS bucket, CASE WHEN k = 0 THEN 0 ELSE 1048576 * (1::BIGINT << (k - 1)::INT) END::BIGINT AS border FROM range(0, (SELECT max(bucket) + 1 FROM nodes)) t(k)")
#: Buckets by decimal digits.
DIGITS = C.BucketModel(C.digit_count, lambda k: F.pow(F.lit(10), k).cast("long"))
_add("custom_bucket_model", lambda n: R.histogram(n, model=DIGITS).where("files > 0").select(F.col("bucket").alias("digits"), "files"), "SELECT length(size::VARCHAR)::INT AS digits, count(*) AS files FROM nodes WHERE type = 'FILE' GROUP BY 1")
_add("bucket_model_of_powers", lambda n: R.histogram(n, model=C.powers(10, 1000)).withColumn("border", C.powers(10, 1000).border(F.col("bucket"))), "SELECT k::INT AS bucket, count(b) AS files, CASE WHEN k = 0 THEN 0 ELSE (1000 * 10 ** (k - 1)) END::BIGINT AS border FROM range(0, (SELECT max(CASE WHEN size = 0 THEN 0 ELSE greatest(1, length(size::VARCHAR) - 2) END) + 1 FROM nodes WHERE type = 'FILE')) t(k) LEFT JOIN (SELECT CASE WHEN size = 0 THEN 0 ELSE greatest(1, length(size::VARCHAR) - 2) END AS b FROM nodes WHERE type = 'FILE') ON b = k GROUP BY k")

_add("smallfiles_overall", lambda n: R.small_files(n).agg(F.count(F.lit(1)).alias("small_files")), "SELECT count(*) AS small_files FROM small")
_by_dir = lambda n: R.small_files(n).groupBy("parent_path").agg(F.count(F.lit(1)).alias("small_files"))
_by_user_dir = lambda n: R.small_files(n).groupBy("owner", "parent_path").agg(F.count(F.lit(1)).alias("small_files"))
_add("smallfiles_by_dir", _by_dir, "SELECT parent_path, count(*) AS small_files FROM small GROUP BY 1")
_add("smallfiles_by_user_dir", _by_user_dir, "SELECT owner, parent_path, count(*) AS small_files FROM small GROUP BY 1, 2")
_add("smallfiles_by_user", lambda n: R.small_files(n).groupBy("owner").agg(F.count(F.lit(1)).alias("small_files")).orderBy(F.desc("small_files"), "owner"), "SELECT owner, count(*) AS small_files FROM small GROUP BY 1 ORDER BY 2 DESC, 1")
_add("smallfiles_totals", lambda n: R.small_files(n).agg(F.sum(F.col("owner").rlike(r"\A(?:[12].*)\z").cast("int")).cast("long").alias("of_users"), F.count(F.lit(1)).alias("overall")), "SELECT sum(regexp_full_match(owner, '[12].*')::INT)::BIGINT AS of_users, count(*) AS overall FROM small")
_add("smallfiles_user_filter", lambda n: R.small_files(n, user="[12].*").groupBy("owner").agg(F.count(F.lit(1)).alias("small_files")), "SELECT owner, count(*) AS small_files FROM small WHERE regexp_full_match(owner, '[12].*') GROUP BY 1")


def _share(n):
    small = R.small_files(n)
    total = small.agg(F.count(F.lit(1)).alias("total"))
    per = small.groupBy("owner").agg(F.count(F.lit(1)).alias("small_files"))
    # the total is one row
    return per.join(F.broadcast(total)).select("owner", "small_files", F.round(F.col("small_files") * 100.0 / F.col("total"), 4).alias("percent"))


_add("smallfiles_user_share", _share, "SELECT owner, count(*) AS small_files, round(count(*) * 100.0 / (SELECT count(*) FROM small), 4) AS percent FROM small GROUP BY 1")
_add("smallfiles_rollup", lambda n: R.roll_up(_by_user_dir(n), "small_files", ("owner",)), "SELECT owner, up AS path, count(*) AS small_files FROM small JOIN anc ON dir = parent_path GROUP BY 1, 2")
_add("smallfiles_top_paths", lambda n: R.roll_up(_by_dir(n), "small_files").orderBy(F.desc("small_files"), "path").limit(10), "SELECT up AS path, count(*) AS small_files FROM small JOIN anc ON dir = parent_path GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def _hotspots(n):
    return T.hotspots(_by_user_dir(n)).drop("all")


_add("smallfiles_hotspots", _hotspots, "SELECT owner, path, small_files, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY small_files DESC, path) AS rank FROM (SELECT owner, up AS path, count(*) AS small_files FROM small JOIN anc ON dir = parent_path WHERE owner IN (SELECT owner FROM small GROUP BY 1 ORDER BY count(*) DESC, owner LIMIT 10) GROUP BY 1, 2)) WHERE rank <= 10")
_direct = lambda n: R.top_per_key(_by_user_dir(n).withColumnRenamed("parent_path", "path"), "owner", "small_files", 10)
_add("smallfiles_hotspots_direct", _direct, "SELECT owner, path, small_files, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY small_files DESC, path) AS rank FROM (SELECT owner, parent_path AS path, count(*) AS small_files FROM small GROUP BY 1, 2)) WHERE rank <= 10")


def _small_csv(n):
    by = _by_user_dir(n)
    rows = lambda df, kind, name, path: df.select(F.lit(kind).alias("type"), name.alias("name"), path.alias("path"), F.col("small_files").cast("long").alias("small_files"))
    overall = rows(by.agg(F.sum("small_files").alias("small_files")), "Overall", F.lit("/"), F.lit(""))
    users = rows(by.groupBy("owner").agg(F.sum("small_files").alias("small_files")), "User", F.col("owner"), F.lit(""))
    return overall.unionByName(users).unionByName(rows(_direct(n), "Hotspot", F.col("owner"), F.col("path")))


_add("smallfiles_csv_rows", _small_csv, "SELECT 'Overall' AS type, '/' AS name, '' AS path, count(*) AS small_files FROM small UNION ALL SELECT 'User', owner, '', count(*) FROM small GROUP BY owner UNION ALL SELECT 'Hotspot', owner, path, small_files FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY small_files DESC, path) AS rank FROM (SELECT owner, parent_path AS path, count(*) AS small_files FROM small GROUP BY 1, 2)) WHERE rank <= 10")

USER = "1-urgent"
_used = "SELECT parent_path, sum(size)::BIGINT AS size FROM nodes WHERE type = 'FILE' AND lower(owner) = '1-urgent'"
_add("userusage_by_dir", lambda n: R.user_usage(n, USER), f"{_used} GROUP BY 1")
_add("userusage_aged", lambda n: R.user_usage(n, USER, CUTOFF_MS), f"{_used} AND mtime_ms < {CUTOFF_MS} GROUP BY 1")
_rolled = f"SELECT up AS path, sum(size)::BIGINT AS size FROM ({_used} GROUP BY 1) JOIN anc ON dir = parent_path GROUP BY 1"
_add("userusage_rollup", lambda n: R.roll_up(R.user_usage(n, USER), "size"), _rolled)
_add("userusage_top", lambda n: R.roll_up(R.user_usage(n, USER), "size").orderBy(F.desc("size"), "path").limit(20), f"{_rolled} ORDER BY size DESC, path LIMIT 20")

_add("tree_paths", lambda n: n.select("id", "path"), "SELECT id, path FROM nodes")
_add("paths_listing", lambda n: R.path_rows(n).orderBy("path"), f"SELECT path, CASE type WHEN 'FILE' THEN '-' WHEN 'DIRECTORY' THEN 'd' ELSE 'l' END AS type, owner || ':' || grp || ':' || {SYMBOLIC} AS permission FROM nodes ORDER BY path")
_add("paths_by_user", lambda n: R.paths(n, user="[1-3].*").select("path", "owner"), "SELECT path, owner FROM nodes WHERE regexp_full_match(owner, '[1-3].*')")
_add("paths_union_distinct", lambda n: R.paths(n, ("/ASIA", "/ASIA/CHINA", "/EUROPE")).select("path"), "SELECT DISTINCT path FROM nodes WHERE path IN ('/ASIA', '/EUROPE') OR starts_with(path, '/ASIA/') OR starts_with(path, '/EUROPE/')")
_add("paths_csv_rows", lambda n: R.path_rows(R.paths(n, ("/ASIA",))), f"SELECT path, CASE type WHEN 'FILE' THEN '-' WHEN 'DIRECTORY' THEN 'd' ELSE 'l' END AS type, owner || ':' || grp || ':' || {SYMBOLIC} AS permission FROM nodes WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')")
_add("path_type_counts", lambda n: n.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT type, count(*) AS n FROM nodes GROUP BY 1")
_add("layout_widths", lambda n: n.agg(*[F.max(F.length(c)).alias(f"{c}_width") for c in ("owner", "grp", "path")]), "SELECT max(length(owner))::INT AS owner_width, max(length(grp))::INT AS grp_width, max(length(path))::INT AS path_width FROM nodes")
_node = "id, type, name, path, owner, grp"
_list = ["id", "type", "name", "path", "owner", "grp"]
_add("inode_by_id", lambda n: n.where("id = 400000001").select(*_list), f"SELECT {_node} FROM nodes WHERE id = 400000001")
_add("inode_by_path", lambda n: n.where("path = '/ASIA'").select(*_list), f"SELECT {_node} FROM nodes WHERE path = '/ASIA'")
_add("inode_count", lambda n: n.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM nodes")
_ARGS = ["16385", "/ASIA", "/nowhere", "400000001", "7"]


def _info(n):
    asked = n.sparkSession.createDataFrame([(a,) for a in _ARGS], "arg string")
    found = n.select(F.explode(F.array(F.col("id").cast("string"), "path")).alias("arg"), "id", "type", "name")
    return asked.join(found, "arg", "left").select("arg", "id", "type", "name", F.when(F.col("id").isNull(), "not found").alias("error"))


_add("inode_info", _info, "SELECT arg, id, type, n.name, CASE WHEN id IS NULL THEN 'not found' END AS error FROM (VALUES ('16385'), ('/ASIA'), ('/nowhere'), ('400000001'), ('7')) a(arg) LEFT JOIN nodes n ON n.path = arg OR n.id::VARCHAR = arg")
_add("path_exists", lambda n: n.sparkSession.createDataFrame([("/ASIA",), ("/nowhere",), ("/",)], "path string").join(n.select("path", F.lit(True).alias("found")), "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("present")), "SELECT v.path, v.path IN (SELECT path FROM nodes) AS present FROM (VALUES ('/ASIA'), ('/nowhere'), ('/')) v(path)")
_add("path_normalize", lambda n: n.select("id", C.normalize_path(F.concat(F.lit("//"), F.replace("path", F.lit("/"), F.lit("//")), F.lit("/"))).alias("path")), "SELECT id, path FROM nodes")
_add("child_dirs", lambda n: R.children(n, "/ASIA").where("type = 'DIRECTORY'").select("path"), "SELECT path FROM nodes WHERE parent_path = '/ASIA' AND type = 'DIRECTORY'")
_add("child_dirs_filtered", lambda n: R.children(n, "/ASIA").where((F.col("type") == "DIRECTORY") & F.col("name").contains("A")).select("path"), "SELECT path FROM nodes WHERE parent_path = '/ASIA' AND type = 'DIRECTORY' AND contains(name, 'A')")
_add("files_in_dir", lambda n: n.where("type = 'FILE' and parent_id = 300000001").select("id", "name", "size"), "SELECT id, name, size FROM nodes WHERE type = 'FILE' AND parent_id = 300000001")
_dirs = lambda n: n.where("type = 'DIRECTORY'").select("id", "path")
_parents = lambda n: n.where("path <> '/'").select(F.col("parent_id").alias("id"))
_add("dirs_with_children", lambda n: _dirs(n).join(_parents(n), "id", "left_semi"), "SELECT id, path FROM nodes WHERE type = 'DIRECTORY' AND id IN (SELECT parent_id FROM nodes)")
_add("empty_dirs", lambda n: _dirs(n).join(_parents(n), "id", "left_anti"), "SELECT id, path FROM nodes WHERE type = 'DIRECTORY' AND id NOT IN (SELECT parent_id FROM nodes)")
_add("child_counts", R.child_counts, "SELECT id, path, coalesce(c, 0) AS n_children FROM nodes LEFT JOIN (SELECT parent_id AS p, count(*) AS c FROM nodes WHERE path <> '/' GROUP BY 1) ON p = id")


def _edges_resolved(spark, sf_dir):
    """Plain children, and reference children (here: suppliers seen again from the root) looked up by their ordinal."""
    plain = S.edges(spark, sf_dir).select("parent_id", "child_id", F.lit(False).alias("is_ref"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    refs = supplier.selectExpr("s_suppkey as ref_idx", "500000000 + s_suppkey as inode_id")
    seen = supplier.selectExpr("cast(16385 as bigint) as parent_id", "s_suppkey as ref_idx")
    return plain.unionByName(seen.join(refs, "ref_idx").select("parent_id", F.col("inode_id").alias("child_id"), F.lit(True).alias("is_ref")))


QUERIES["edges_resolved"] = _edges_resolved
ORACLES["edges_resolved"] = NODES_SQL + "SELECT parent_id, id AS child_id, false AS is_ref FROM nodes WHERE id <> 16385 UNION ALL SELECT 16385, 500000000 + s_suppkey, true FROM supplier"

_add("permission_unpack", lambda n: n.select("id", *[c.alias(k) for k, c in C.unpack_permission((F.lit(5).cast("long") * (1 << 40) + F.lit(4 << 16) + F.col("mode"))).items()]), "SELECT id, 5::BIGINT AS user_id, 4::BIGINT AS group_id, mode FROM nodes")
_add("permission_format", lambda n: n.select("id", C.permission_text(F.col("owner"), F.col("grp"), F.col("mode")).alias("permission")), f"SELECT id, owner || ':' || grp || ':' || {OCTAL} AS permission FROM nodes")
_add("permission_symbolic", lambda n: n.select("id", C.symbolic_mode(F.col("mode")).alias("permission")), f"SELECT id, {SYMBOLIC} AS permission FROM nodes")
_add("storage_policy", lambda n: n.where("type = 'FILE'").select("id", C.storage_policy(F.when(F.col("id") % 4 == 1, 10).when(F.col("id") % 4 == 2, 0).when(F.col("id") % 4 == 3, 2)).alias("policy")), "SELECT id, CASE id % 4 WHEN 1 THEN 'ONE_SSD' WHEN 3 THEN 'COLD' ELSE 'HOT' END AS policy FROM nodes WHERE type = 'FILE'")
_add("file_replication", lambda n: n.where("type = 'FILE'").select("id", F.col("effective_replication").alias("replication")), "SELECT id, CASE WHEN ec IS NULL THEN replication ELSE 1 END AS replication FROM nodes WHERE type = 'FILE'")
_add("file_size", lambda n: n.where("type = 'FILE'").select("id", "size", "n_blocks"), "SELECT id, size, n_blocks FROM nodes WHERE type = 'FILE'")
_add("consumed_size", lambda n: n.where("type = 'FILE'").select("id", "consumed"), "SELECT id, consumed FROM nodes WHERE type = 'FILE'")
_add("iec_format", lambda n: n.where("type = 'FILE'").select("id", C.iec_format(F.col("size")).alias("label")), "SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN CAST(floor(size / 1024.0 + 0.5) AS BIGINT) || ' KiB' WHEN size < 1073741824 THEN CAST(floor(size / 1048576.0 + 0.5) AS BIGINT) || ' MiB' ELSE CAST(floor(size / 1073741824.0 + 0.5) AS BIGINT) || ' GiB' END AS label FROM nodes WHERE type = 'FILE'")
_add("iec_parse", lambda n: n.where("type = 'FILE'").select("id", C.iec_parse(F.concat((F.col("id") % 1000).cast("string"), F.lit(" mib"))).alias("bytes")), "SELECT id, (id % 1000) * 1048576 AS bytes FROM nodes WHERE type = 'FILE'")
_add("digit_count", lambda n: n.select("id", C.digit_count(F.col("size")).alias("digits")), "SELECT id, length(size::VARCHAR)::INT AS digits FROM nodes")

_add("mebibytes", lambda n: n.where("type = 'FILE'").select("id", C.mebibytes(F.col("size")).alias("mb")), "SELECT id, size // 1048576 AS mb FROM nodes WHERE type = 'FILE'")
_add("type_letters", lambda n: n.select("id", C.type_char(F.col("type")).alias("kind"), C.type_letter(F.col("type")).alias("letter")), "SELECT id, CASE type WHEN 'FILE' THEN '-' WHEN 'DIRECTORY' THEN 'd' ELSE 'l' END AS kind, CASE type WHEN 'FILE' THEN 'f' WHEN 'DIRECTORY' THEN 'd' ELSE 'l' END AS letter FROM nodes")
_add("size_labels", lambda n: n.groupBy("owner").agg(F.array(F.max("size"), F.sum("size")).alias("sizes")).select("owner", F.array_join(C.size_labels(F.col("sizes")), ", ").alias("labels")), "SELECT owner, " + " || ', ' || ".join(f"CASE WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} < 1048576 THEN CAST(floor({x} / 1024.0 + 0.5) AS BIGINT) || ' KiB' WHEN {x} < 1073741824 THEN CAST(floor({x} / 1048576.0 + 0.5) AS BIGINT) || ' MiB' WHEN {x} < 1099511627776 THEN CAST(floor({x} / 1073741824.0 + 0.5) AS BIGINT) || ' GiB' ELSE CAST(floor({x} / 1099511627776.0 + 0.5) AS BIGINT) || ' TiB' END" for x in ("max(size)", "sum(size)::BIGINT")) + " AS labels FROM nodes GROUP BY owner")
_add("padded_histogram", lambda n: R.statistics(n).where("level = 'group'").select("name", F.array_join(C.padded(F.col("buckets"), 20), ",").alias("counts")), "SELECT grp AS name, " + " || ',' || ".join(f"count(*) FILTER (bucket = {k})" for k in range(20)) + " AS counts FROM nodes GROUP BY grp")
_add("column_widths", lambda n: R.statistics(n).agg(*[F.max(F.element_at(C.elementwise_max(C.text_lengths(F.transform("buckets", lambda b: b.cast("string"))), F.array_repeat(F.lit(2), 18)), k + 1)).alias(f"width_{k}") for k in range(4)]), "SELECT " + ", ".join(f"max(greatest(2, length(c{k}::VARCHAR)))::INT AS width_{k}" for k in range(4)) + " FROM (SELECT " + ", ".join(f"count(*) FILTER (bucket = {k}) AS c{k}" for k in range(4)) + " FROM nodes GROUP BY GROUPING SETS ((), (grp), (owner)))")
_add("child_ids", lambda n: n.where("path <> '/'").groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("children")), "SELECT parent_id AS id, string_agg(id::VARCHAR, ',' ORDER BY id) AS children FROM nodes WHERE path <> '/' GROUP BY 1")
_add("dirs_without_dirs", lambda n: _dirs(n).join(n.where("type = 'DIRECTORY' and path <> '/'").select(F.col("parent_id").alias("id")), "id", "left_anti"), "SELECT id, path FROM nodes WHERE type = 'DIRECTORY' AND id NOT IN (SELECT parent_id FROM nodes WHERE type = 'DIRECTORY')")
_add("visited", lambda n: L.visit(n, on_file=lambda f: f.select("path", F.col("size").alias("n")), on_directory=lambda d: d.select("path", F.lit(0).cast("long").alias("n")), on_symlink=lambda k: k.select("path", F.length("name").cast("long").alias("n"))), "SELECT path, CASE type WHEN 'FILE' THEN size WHEN 'DIRECTORY' THEN 0 ELSE length(name) END AS n FROM nodes")
_add("sticky_directories", lambda n: n.where("type = 'DIRECTORY'").select("id", C.symbolic_mode(F.when(F.col("id") % 2 == 0, F.lit(0o1777)).otherwise(0o1754)).alias("permission")), "SELECT id, CASE WHEN id % 2 = 0 THEN 'rwxrwxrwt' ELSE 'rwxr-xr-T' END AS permission FROM nodes WHERE type = 'DIRECTORY'")
_add("unsigned_quotas", lambda n: n.where("type = 'DIRECTORY'").select("id", C.unsigned(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).cast("long")).cast("string").alias("quota")), "SELECT id, CASE WHEN id % 2 = 0 THEN '18446744073709551615' ELSE id::VARCHAR END AS quota FROM nodes WHERE type = 'DIRECTORY'")


def _inode_permission(n):
    """Owners and groups through a dictionary of numbers, packed with the mode and resolved again, as an image holds them."""
    names = n.select(F.explode(F.array("owner", "grp")).alias("str")).distinct()
    # written, so that its size is known before the nodes are joined with it: they stay in place unless it is large
    strings = table(names.select((F.conv(F.substring(F.md5("str"), 1, 6), 16, 10).cast("long")).alias("id"), "str", F.lit(None).cast("int").alias("space")))
    number = lambda c: strings.select(F.col("str").alias(c), F.col("id").alias(f"{c}_number"))
    packed = n.join(number("owner"), "owner").join(number("grp"), "grp").withColumn("permission", F.shiftleft("owner_number", 40) + F.shiftleft("grp_number", 16) + F.col("mode"))
    acl = F.array().cast("array<struct<scope:string,type:string,name_id:int,perm:int>>")
    return I.named(packed.select("id", "permission", acl.alias("acl")), strings).select("id", "owner", "grp", "mode")


_add("inode_permission", _inode_permission, "SELECT id, owner, grp, mode FROM nodes")


def _inode_json(n):
    is_file, is_dir = F.col("type") == "FILE", F.col("type") == "DIRECTORY"
    return n.withColumns({
        "preferred_block_size": F.when(is_file, F.lit(134217728).cast("long")), "storage_policy_id": F.when(is_file, F.lit(7)),
        "ns_quota": F.when(is_dir, F.lit(-1).cast("long")), "ds_quota": F.when(is_dir, F.lit(-1).cast("long")), "target": F.when(~is_file & ~is_dir, F.lit("/")),
    }).select(T.inode_json_columns().alias("inode"))


_head = "'{\"id\":' || id || ',\"name\":\"' || name || '\",\"type\":\"' || lower(type) || '\",\"permission\":\"' || owner || ':' || grp || ':' || " + OCTAL
_times = "'\"mtime\":' || mtime_ms || ',\"atime\":' || mtime_ms"
_add("inode_json", _inode_json, f"SELECT {_head} || '\",' || CASE type WHEN 'FILE' THEN {_times} || ',\"replication\":' || replication || ',\"preferredBlockSize\":134217728,\"storagePolicyID\":7,\"erasureCodingPolicyID\":' || coalesce(ec, 0) WHEN 'DIRECTORY' THEN '\"nsQuota\":-1,\"dsQuota\":-1,' || {_times} ELSE '\"target\":\"/\",' || {_times} END || '}}' AS inode FROM nodes")


def _resolved(n):
    return L.resolve_arguments(n, [*_ARGS, "//ASIA/", "relative"]).select(F.col("nth").alias("k"), "arg", "id", "path")


_add("inode_arguments", _resolved, "SELECT k, arg, id, path FROM (VALUES (0, '16385', '16385'), (1, '/ASIA', '/ASIA'), (2, '/nowhere', '/nowhere'), (3, '400000001', '400000001'), (4, '7', '7'), (5, '//ASIA/', '/ASIA'), (6, 'relative', 'relative')) a(k, arg, plain) LEFT JOIN nodes n ON n.path = plain OR n.id::VARCHAR = plain")
_add("smallfiles_direct_by_user", lambda n: T.direct_hotspots(_by_user_dir(n), "[12].*", 3), "SELECT owner, path, small_files, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY small_files DESC, path) AS rank FROM (SELECT owner, parent_path AS path, count(*) AS small_files FROM small WHERE regexp_full_match(owner, '[12].*') GROUP BY 1, 2)) WHERE rank <= 3")
_add("statistics", lambda n: R.statistics(n).withColumn("buckets", F.array_join("buckets", ",")), "SELECT CASE WHEN grouping(grp) = 0 THEN 'group' WHEN grouping(owner) = 0 THEN 'user' ELSE 'overall' END AS level, coalesce(grp, owner, '/') AS name, " + TOTALS + ", " + " || ',' || ".join(f"count(*) FILTER (bucket = {k})" for k in range(18)) + " AS buckets FROM nodes GROUP BY GROUPING SETS ((), (grp), (owner))")
