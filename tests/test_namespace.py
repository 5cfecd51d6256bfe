"""Queries against DuckDB on the smallest data, and scalar functions against fixed vectors."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dirgauge.functions import columns as C
from dirgauge.operators import reports as R
from dirgauge.plans import store, tree
from dirgauge.sources import tables

SF = "/root/testdata/sf0.001"
CHECKED = ["summary_grouping_sets", "smallfiles_rollup", "userusage_aged", "paths_csv_rows", "inode_info", "edges_resolved", "size_histogram", "statistics", "inode_json", "inode_permission", "inode_arguments", "bucket_model_of_powers", "smallfiles_hotspots", "visited"]


def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier orders lineitem".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_matches_duckdb(spark, name):
    got = entry.queries()[name](spark, SF)
    want = duck().sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, (tuple(r[k] for k in at) for r in want.fetchall())))


def test_totals(spark):
    row = entry.queries()["summary_overall"](spark, SF).first()
    assert (row.dirs, row.links, row.files, row["size"], row.consumed, row.blocks) == (181, 10, 1500, 21007052800, 42559750144, 6000)


def values(spark, column, rows, kind):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


def test_scalars(spark):
    assert values(spark, C.normalize_path, ["/", "//", "//test/foo", "/test//foo", "/test//foo///bar///"], "string") == ["/", "/", "/test/foo", "/test/foo", "/test/foo/bar"]
    assert values(spark, C.size_bucket, [0, 1, 2**20, 2**21, 2**22, 300 * 2**30], "bigint") == [0, 1, 2, 3, 4, 20]
    assert values(spark, C.iec_format, [0, 1024, 1535, 1536, 3 * 2**20, 5 * 2**40, 60 * 2**50], "bigint") == ["0 B", "1 KiB", "1 KiB", "2 KiB", "3 MiB", "5 TiB", "60 PiB"]
    assert values(spark, C.iec_parse, ["0", "0B", "1  KiB", "5 MB", "", "KiB"], "string") == [0, 0, 1024, 5, None, None]
    assert values(spark, C.symbolic_mode, [0o755, 0o1755, 0o1644], "int") == ["rwxr-xr-x", "rwxr-xr-t", "rw-r--r-T"]
    assert values(spark, C.octal_mode, [0o644, 0o1755], "int") == ["0644", "1755"]
    assert values(spark, lambda c: C.block_consumed(c, F.lit(3), F.lit(1)), [10 * 2**20, 1, 0], "bigint") == [16 * 2**20, 3145729, 0]
    assert values(spark, C.unsigned, [-1, 5], "bigint") == [18446744073709551615, 5]
    assert values(spark, C.ancestors_or_self, ["/", "/a/b"], "string") == [["/"], ["/", "/a", "/a/b"]]
    assert C.parse_age("2d") == 172800000 and C.parse_age("") == 0
    with pytest.raises(ValueError):
        C.parse_age("60")


def test_limit_is_strict_and_roll_up_ends_at_root(spark):
    rows = [("FILE", "u", "/a/b", 2 * 2**20), ("FILE", "u", "/a/b", 5), ("FILE", "v", "/", 7)]
    nodes = spark.createDataFrame(rows, "type string, owner string, parent_path string, size bigint")
    by = R.small_files(nodes).groupBy("parent_path").agg(F.count(F.lit(1)).alias("n"))
    assert {(r.path, r.n) for r in R.roll_up(by, "n").collect()} == {("/", 2), ("/a", 1), ("/a/b", 1)}


def test_nodes_are_written_once_for_each_state(spark, tmp_path):
    df = spark.range(3)
    calls = []
    build = lambda: calls.append(1) or df
    (tmp_path / "in").write_text("a")
    key = lambda: ("k", store.state(spark, [str(tmp_path / "in")]))
    first = store.once(spark, key(), build)
    assert store.once(spark, key(), build) is first and len(calls) == 1 and first.count() == 3
    (tmp_path / "in").write_text("ab")
    assert store.once(spark, key(), build) is not first and len(calls) == 2
    path = store._kept[(spark.sparkContext.applicationId, *key())][0]
    shutil.rmtree(path.removeprefix("file:"))
    assert store.once(spark, key(), build).count() == 3 and len(calls) == 3
    assert store.state(spark, [str(tmp_path / "none")]) == ()


def test_paths_of_deep_trees_lost_nodes_and_cycles(spark):
    rows = [(k, k - 1, f"d{k}") for k in range(2, 202)] + [(1, 0, ""), (900, 899, "lost"), (5, 3, "again")]
    got = {(r.id, r.path, r.depth) for r in tree.directory_paths(spark.createDataFrame(rows, "id bigint, parent_id bigint, name string"), 1).collect()}
    path = lambda k: "/" + "/".join(f"d{j}" for j in range(2, k + 1)) if k > 1 else "/"
    want = {(k, path(k), k - 1) for k in range(1, 202)} | {(k, f"/d2/d3/again{path(k).removeprefix(path(5))}", k - 2) for k in range(5, 202)}
    assert got == want
    with pytest.raises(ValueError, match="cycle"):
        tree.directory_paths(spark.createDataFrame([(1, 0, ""), (2, 3, "a"), (3, 2, "b")], "id bigint, parent_id bigint, name string"), 1, max_depth=50)


def test_files_are_not_written_or_moved_again_for_their_order(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(tree, "table", lambda df: kept.append(store.table(df)) or kept[-1])
    nodes = tables.derive(spark, SF)
    assert all(t.count() < 1500 for t in kept)  # directories only; there are 1,500 files
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange " in line]
    assert moved and not any("rangepartitioning" in line for line in moved)
    nodes.write.parquet(str(tmp_path / "nodes"))
    for part in (tmp_path / "nodes").glob("*.parquet"):
        paths = [r[0] for r in duckdb.sql(f"SELECT path FROM read_parquet('{part}', file_row_number = true) ORDER BY file_row_number").fetchall()]
        assert paths == sorted(paths)


def test_sums_of_blocks_are_those_of_each_block(spark, tmp_path):
    orders = [(k, k % 3, "1-URGENT", None) for k in range(12)]
    lines = [(k, float(n)) for k in range(12) for n in (1, 700, 17, 50)[: k % 5]] + [(3, None), (77, 5.0)]
    customers = [(0, "a", 0, "x"), (1, "b", 0, None)]  # customer 2 is missing
    save = lambda rows, kind, name: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    save(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderdate timestamp", "orders")
    save(lines, "l_orderkey bigint, l_quantity double", "lineitem")
    save(customers, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string", "customer")
    save([(0, "R")], "r_regionkey int, r_name string", "region")
    save([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    save([(0, "S", 0), (1, "lost", 9)], "s_suppkey bigint, s_name string, s_nationkey int", "supplier")
    got = {r.path: r for r in tables.derive(spark, str(tmp_path)).collect()}
    assert set(got) == {"/", "/R", "/R/N", "/R/N/a", "/R/N/b", "/R/N/S", *[f"/R/N/{'ab'[k % 3]}/order_{k}" for k in range(12) if k % 3 < 2]}
    for k in (k for k in range(12) if k % 3 < 2):
        bytes_ = [int(q * q * 4096) for key, q in lines if key == k and q is not None]
        ec, row = {0: (6, 3), 5: (3, 2)}.get(k % 10), got[f"/R/N/{'ab'[k % 3]}/order_{k}"]
        taken = [n + -(-(-(-n // C.CELL)) // ec[0]) * ec[1] * C.CELL if ec else n * (1 + k % 3) for n in bytes_]
        assert (row["size"], row.consumed, row.n_blocks, row.grp) == (sum(bytes_), sum(taken), len(bytes_) + (k == 3), ("x", None)[k % 3])


def test_permissions_are_resolved_where_the_nodes_are(spark):
    entry.queries()["inode_permission"](spark, SF).count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 4096)
    try:
        plan = entry.queries()["inode_permission"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
