"""Reports on the small image, as text, CSV and JSON, and the command line's errors."""

import csv
import io
import json
from datetime import datetime

import image_writer as w
import pytest

from dirgauge.__main__ import arguments, parser, run
from dirgauge.operators import lookups, reports
from dirgauge.render import text
from dirgauge.sources import image, tables

TABLES = "/root/testdata/sf0.001"
ROWS = """\
              root |            0 |         0 |          1 |         0 |         0 |         1 |   0     1     0     0     0      0      0      0       0       0
        supergroup |            8 |         0 |          8 |       151 |       151 |         8 |   0     1     1     2     1      0      1      1       1       0
            nobody |            0 |         0 |          2 |       180 |       180 |         3 |   0     0     0     0     0      0      1      0       0       1
"""
USERS = """\
              root |            0 |         0 |          1 |         0 |         0 |         1 |   0     1     0     0     0      0      0      0       0       0
               foo |            0 |         0 |          1 |       160 |       160 |         2 |   0     0     0     0     0      0      0      0       0       1
                mm |            8 |         0 |          9 |       171 |       171 |         9 |   0     1     1     2     1      0      2      1       1       0
"""
BORDERS = "0 B 1 MiB 2 MiB 4 MiB 8 MiB 16 MiB 32 MiB 64 MiB 128 MiB 256 MiB"


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    return w.write_small(tmp_path_factory.mktemp("image") / "small.img")


@pytest.fixture(scope="module")
def nodes(spark, small):
    return image.nodes(spark, small).cache()


@pytest.fixture
def told(spark, small):
    def call(*args, before=()):
        out = io.StringIO(newline="")
        assert run(spark, arguments([*before, small, *args]), out) == 0
        return out.getvalue()

    return call


def said(write, *args, **more):
    out = io.StringIO(newline="")
    write(*args, out, **more)
    return out.getvalue()


def wide(rows):
    return "".join(f"    {line}\n" for line in rows.splitlines())


def test_summary_text(told):
    out = told()
    assert out.startswith("\nHDFS Summary : /\n----------------\n\n#Groups  | #Users      | #Directories | #Symlinks |  #Files     | Size [MB] | CSize[MB] | #Blocks   | File Size Buckets \n")
    lines = out.splitlines()
    assert lines[5].endswith(f"| {BORDERS}") and lines[6] == "-" * len(lines[5])
    assert lines[7] == "       3 |           3 |            8 |         0 |         11 |       331 |       331 |        12 |   0     2     1     2     1      0      2      1       1       1"
    assert lines[9] == "By group:            3 | #Directories | #SymLinks | #File      | Size [MB] | CSize[MB] | #Blocks   | File Size Buckets" and lines[11] == "-" * len(lines[10])
    assert "".join(f"{x}\n" for x in lines[12:15]) == wide(ROWS) and lines[15] == ""
    assert lines[16].startswith("By user:             3 |") and "".join(f"{x}\n" for x in lines[19:]) == wide(USERS)


def test_summary_filter_is_found_in_names_and_selects_users_only(told, nodes):
    out = told(before=["-fun", "^fo"])
    assert wide(ROWS) in out and "By user:             1 |" in out and out.endswith(wide(USERS.splitlines(keepends=True)[1]))
    assert told("-o", "csv", before=["-fun", "foo"]) == told("-o", "csv")
    assert said(text.summary_text, nodes, "/", user="o", sort="dc").count("\n") == said(text.summary_text, nodes, "/").count("\n") - 1


def test_summary_csv_and_json(told):
    rows = list(csv.reader(io.StringIO(told("summary", "-o", "csv"), newline="")))
    assert rows[0] == ["Type", "Name", "Directories", "Symlinks", "Files", "Size", "Blocks", "Size Buckets (0B to 256MiB+)"]
    assert rows[1] == ["Overall", "/", "8", "0", "11", "348019712", "12", "[0, 2, 1, 2, 1, 0, 2, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]"]
    assert [r[:5] for r in rows[2:]] == [["Group", "nobody", "0", "0", "2"], ["Group", "root", "0", "0", "1"], ["Group", "supergroup", "8", "0", "8"], ["User", "foo", "0", "0", "1"], ["User", "mm", "8", "0", "9"], ["User", "root", "0", "0", "1"]]
    out = told("-o", "json")
    assert '  "dirPath": "/"' in out and '"overallStats": {' in out
    got = json.loads(out)
    assert list(got) == ["groupStats", "userStats", "overallStats", "dirPath"] and got["userStats"]["mm"]["userName"] == "mm"
    assert got["overallStats"] | {"fileSizeBuckets": 0} == {"sumFiles": 11, "sumDirectories": 8, "sumSymLinks": 0, "sumBlocks": 12, "sumFileSize": 348019712, "sumConsumedFileSize": 348019712, "fileSizeBuckets": 0}
    assert got["groupStats"]["root"]["fileSizeBuckets"] == [{"0 B": 0}, {"1 MiB": 1}]


def test_small_files_text(told):
    head = "\nSmall files report (< 2 MiB)\n\n"
    paths = "#Small files  | Path (top 10) \n------------------------------\n            3 | /\n            2 | /test3\n            1 | /test3/foo\n\n"
    users = "Username | #Small files | %\n------------------------------------\nmm       |            2 | 66.7%\n"
    spots = "\nUsername | Small files hotspots (top 10 count/path)\n---------------------------------------------------\nmm       |            2 | /\n         |            1 | /test3\n---------------------------------------------------\n"
    root = "root     |            1 | /\n         |            1 | /test3\n         |            1 | /test3/foo\n---------------------------------------------------\n"
    assert told("smallfiles") == f"{head}Overall small files : 3\n\n{paths}{users}root     |            1 | 33.3%\n{spots}{root}"
    assert told("sf", before=["-fun", "mm"]) == f"{head}Overall small files         : 3\nUser (filtered) small files : 2\n\n{paths}{users}{spots}"
    out = told("sf", "--fsl", "3MiB", before=["-fun", "m.*"])
    assert "Overall small files         : 4\nUser (filtered) small files : 3\n" in out and "mm       |            3 | /\n         |            2 | /test3\n         |            1 | /test3/foo\n         |            1 | /test3/foo/bar\n" in out
    assert told("sf", before=["-fun", "m"]).endswith("No users found in directory paths [/]\n")
    assert "(top 1)" in told("sf", "--uphl", "1") and "root " in told("sf", "--uphl", "1")


def test_small_files_csv_and_json_hold_direct_counts(told):
    assert told("sf", "-o", "csv").split("\r\n") == ["Type,Name,Path,Small Files", "Overall,/,,3", "User,mm,,2", "User,root,,1", "Hotspot,mm,/,1", "Hotspot,mm,/test3,1", "Hotspot,root,/test3/foo,1", ""]
    got = json.loads(told("sf", "-o", "json", before=["-fun", "mm"]))
    assert got == {"userToReport": {"mm": {"userName": "mm", "pathToCounter": {"/": 1, "/test3": 1}, "sumSmallFiles": 2}}, "pathToCounter": {"/": 1, "/test3": 1, "/test3/foo": 1}, "sumUserSmallFiles": 2, "sumOverallSmallFiles": 3}


def test_usage(told, nodes):
    rows = "/              | {} MiB\n/test3         | {} MiB\n/test3/foo     | 171 MiB\n/test3/foo/bar | 151 MiB\n"
    assert told("userusage", "mm") == "\nSize report (user=mm, start dir=/)\n\n" + rows.format(172, 172)
    assert told("uu", "MM", before=["-p", "/test3/foo"]) == "\nSize report (user=MM, start dir=/test3/foo)\n\n" + rows.format(171, 171)
    assert told("uu", "nobody") == "\nSize report (user=nobody, start dir=/)\n\nNo data found\n"
    assert told("uu", "mm", "-l", "1").endswith("\n\n/              | 172 MiB\n")
    out = said(text.usage_text, nodes, "/", user="foo", age_ms=86_400_000, now=datetime(2021, 7, 12, 23, 49, 44, 203_000))
    assert out.startswith("\nSize report (user=foo, start dir=/, last modification older 2021-07-11T23:49:44.203)\n\n/ ")
    assert said(text.usage_text, nodes, "/", user="foo", age_ms=1000, now=datetime(2016, 1, 1)).endswith("No data found\n")
    assert told("uu", "root", "-o", "csv") == "Path,Size\r\n/,1024\r\n/test3,1024\r\n/test3/foo,1024\r\n"
    assert json.loads(told("uu", "root", "-o", "json")) == {"pathToSize": {"/": 1024, "/test3": 1024, "/test3/foo": 1024}}


def test_paths(told):
    out = told("path")
    assert out.startswith("\nPath report (path=/, no filter) :\n---------------------------------\n\n11 files, 8 directories and 0 symlinks\n\ndrwxr-xr-x mm   supergroup /\ndrwxr-xr-x mm   supergroup /test1\n")
    assert "-rw-r--r-- root root       /test3/foo/test_1KiB.img\n" in out and out.count("\n") == 6 + 19
    assert told("p", before=["-fun", "foo"]) == "\nPath report (path=/, user=~foo) :\n---------------------------------\n\n1 file, 0 directories and 0 symlinks\n\n-rw-r--r-- foo nobody /test3/test_160MiB.img\n"
    out = told("p", before=["-fun", "m.*", "-p", "/test3,/test1", "-p", "/test3/foo"])
    assert "Path report (paths=[/test3, /test1, /test3/foo], user=~m.*) :" in out and "\n8 files, 4 directories and 0 symlinks\n" in out
    rows = told("path", "-o", "csv").split("\r\n")
    assert rows[:3] == ["Path,Type,Permission", "/,d,mm:supergroup:rwxr-xr-x", "/test1,d,mm:supergroup:rwxr-xr-x"] and len(rows) == 21
    got = json.loads(told("path", "-o", "json"))
    assert (got["fileCount"], got["dirCount"], got["symLinkCount"], len(got["results"])) == (11, 8, 0, 19)
    assert got["results"][15] == {"path": "/test3/test_160MiB.img", "user": "foo", "group": "nobody", "type": "f", "permission": "rw-r--r--"}


def test_inodes(told, spark, small):
    directory = 'type: DIRECTORY\nid: {}\nname: "{}"\ndirectory {{\n  modificationTime: {}\n  nsQuota: {}\n  dsQuota: 18446744073709551615\n  permission: 1099511759341\n}}\n\n'
    file = 'type: FILE\nid: 16402\nname: "test_160MiB.img"\nfile {\n  replication: 1\n  modificationTime: 1497734744886\n  accessTime: 1497734743534\n  preferredBlockSize: 134217728\n  permission: 5497558401444\n'
    file += "".join(f"  blocks {{\n    blockId: {b}\n    genStamp: {g}\n    numBytes: {n}\n  }}\n" for b, g, n in ((1073741834, 1010, 134217728), (1073741835, 1011, 33554432))) + "  storagePolicyID: 0\n}\n\n"
    unlimited = 18446744073709551615
    assert told("inode", "/", "/test3", "/test3/test_160MiB.img", "16387", "/no", "x") == directory.format(16385, "", 1499493618390, 9223372036854775807) + directory.format(16388, "test3", 1497734744891, unlimited) + file + directory.format(16387, "test2", 1497733426149, unlimited) + "Can not find INode by id/path '/no'\nCan not find INode by id/path 'x'\n"
    got = json.loads(told("i", "/", "/test3/test_160MiB.img", "/non-existent", "-o", "json"))["results"]
    assert got == [
        {"inode_arg": "/", "inode": {"id": 16385, "name": "", "type": "directory", "permission": "mm:supergroup:0755", "nsQuota": 9223372036854775807, "dsQuota": -1, "mtime": 1499493618390, "atime": 1499493618390}},
        {"inode_arg": "/test3/test_160MiB.img", "inode": {"id": 16402, "name": "test_160MiB.img", "type": "file", "permission": "foo:nobody:0644", "mtime": 1497734744886, "atime": 1497734744886, "replication": 1, "preferredBlockSize": 134217728, "storagePolicyID": 0, "erasureCodingPolicyID": 0}},
        {"inode_arg": "/non-existent", "error": "Can not find INode by id/path '/non-existent'"},
    ]
    out, err = io.StringIO(newline=""), io.StringIO()
    assert run(spark, arguments([small, "i", "-o", "csv", "16385", "5"]), out, err) == 0
    assert out.getvalue() == "ID,Name,Type\r\n16385,,DIRECTORY\r\n5,- ERR -,- ERR -\r\n" and err.getvalue() == "Can not find INode by id/path '5'\n"
    assert text.quoted("a\"é'\\") == '"a\\"\\303\\251\\\'\\\\"'


def test_lookups(nodes):
    space = lookups.Namespace(nodes)
    assert space.by_path("//test3//foo/").id == 16389 and space.by_id(16402).path == "/test3/test_160MiB.img" and space.by_path("/").name == ""
    assert space.exists("/test3/test.img") and not space.exists("/test3/nope")
    assert space.child_directories("/test3") == ["/test3/foo"] and space.child_directories("/") == ["/test1", "/test2", "/test3", "/user"]
    assert space.child_directories("/", nodes.name.startswith("test")) == ["/test1", "/test2", "/test3"]
    assert {r.name for r in space.files("/test3").collect()} == {"test.img", "test_160MiB.img"} and space.files("/test1").count() == 0
    assert space.n_children(16390) == 6 and space.has_children("/test3") and not space.has_children("/test1") and space.permission(16402) == "foo:nobody:0644"
    for call, error in ((lambda: space.by_path("test3"), ValueError), (lambda: space.exists("x"), ValueError), (lambda: space.by_path("/nope"), FileNotFoundError), (lambda: space.by_path("/test3/nope/x"), FileNotFoundError), (lambda: space.by_id(1), KeyError), (lambda: space.files("/test_2KiB.img"), NotADirectoryError), (lambda: space.files("/nope"), FileNotFoundError)):
        with pytest.raises(error):
            call()


def test_visitor(nodes):
    got = lookups.visit(nodes, on_file=lambda n: n.selectExpr("path", "size as n"), on_directory=lambda n: n.selectExpr("path", "cast(0 as bigint) as n"))
    assert got.count() == 19 and got.agg({"n": "sum"}).first()[0] == 348019712
    assert lookups.visit(nodes) is None and lookups.visit(nodes, on_symlink=lambda n: n).count() == 0


def test_tables_and_errors(spark, small, tmp_path, capsys):
    out = io.StringIO(newline="")
    assert run(spark, arguments([TABLES, "-o", "csv"]), out) == 0 and out.getvalue().splitlines()[1].startswith("Overall,/,181,10,1500,21007052800,6000,")
    want = reports.small_files(tables.nodes(spark, TABLES)).count()
    assert run(spark, arguments([TABLES, "sf"]), out := io.StringIO()) == 0 and f"Overall small files : {want}\n" in out.getvalue()
    for args, message in (([str(tmp_path / "no.img")], "doesn't exist"), (["-p", "/nope", small], "/nope"), (["-p", "/test_2KiB.img", small], "is no directory")):
        assert run(spark, arguments(args), io.StringIO(), err := io.StringIO()) == 1 and message in err.getvalue() and "-v shows more" in err.getvalue()
    with pytest.raises(FileNotFoundError):
        run(spark, arguments(["-p", "/nope", small, "-v"]), io.StringIO())
    (tmp_path / "bad.img").write_bytes(b"NOTANIMAGE.....")
    assert run(spark, arguments([str(tmp_path / "bad.img")]), io.StringIO(), err := io.StringIO()) == 1 and "not a checkpoint image" in err.getvalue()
    for args in (["x", "sf", "--fsl", "KiB"], ["x", "uu", "mm", "-a", "60"], ["-p", "relative", "x"], ["-fun", "(", "x"], ["x", "uu"]):
        with pytest.raises(SystemExit):
            parser().parse_args(args)
    with pytest.raises(SystemExit):
        parser().parse_args(["-V"])
    assert "Version " in capsys.readouterr().out
    more = arguments(["x", "sf", "--fsl", "3MiB", "-o", "json", "-vv"])
    assert (more.limit, more.output, more.verbose, more.path) == (3 << 20, "json", 2, ["/"])
