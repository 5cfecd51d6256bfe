"""Reports as text for people, CSV and JSON.

Each report yields rows from the cluster with toLocalIterator, sorted there, so that the
driver holds one partition at a time; JSON and CSV are written row by row.
"""

from __future__ import annotations

import csv
import json
import textwrap
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from typing import TextIO

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from dirgauge.functions import columns as C
from dirgauge.operators import reports as R

#: Headings of the summary's columns, whose widths the rows below follow but for one blank.
OVERALL_HEAD = "#Groups  | #Users      | #Directories | #Symlinks |  #Files     | Size [MB] | CSize[MB] | #Blocks   | File Size Buckets "
OVERALL_BLANK = "         |             |              |           |             |           |           |           | "
BY_HEAD = " | #Directories | #SymLinks | #File      | Size [MB] | CSize[MB] | #Blocks   | File Size Buckets"
BY_BLANK = "                       |              |           |            |           |           |           | "
#: The columns of the CSV files.
SUMMARY_CSV = ["Type", "Name", "Directories", "Symlinks", "Files", "Size", "Blocks", "Size Buckets (0B to 256MiB+)"]
SMALL_CSV = ["Type", "Name", "Path", "Small Files"]
PATH_CSV = ["Path", "Type", "Permission"]
USAGE_CSV = ["Path", "Size"]
INODE_CSV = ["ID", "Name", "Type"]

SORTS = {"fs": "size", "fc": "files", "dc": "dirs", "bc": "blocks"}


def write_csv(rows: Iterable, out: TextIO, header: list[str]) -> None:
    """Minimal quoting and CRLF; header names the columns in their order. Nulls are empty."""
    writer = csv.writer(out)
    writer.writerow(header)
    writer.writerows(rows)


class JsonStream:
    """Writes one nested JSON value with an indent of two, member by member."""

    def __init__(self, out: TextIO) -> None:
        self.out, self.depth, self.first = out, 0, True

    def _lead(self, name: str | None) -> None:
        self.out.write(("" if self.depth == 0 else "\n" if self.first else ",\n") + "  " * self.depth)
        if name is not None:
            self.out.write(f"{json.dumps(name, ensure_ascii=False)}: ")

    def value(self, value, name: str | None = None) -> None:
        self._lead(name)
        self.out.write(textwrap.indent(json.dumps(value, indent=2, ensure_ascii=False), "  " * self.depth).lstrip())
        self.first = False

    def begin(self, bracket: str, name: str | None = None) -> None:
        self._lead(name)
        self.out.write(bracket)
        self.depth, self.first = self.depth + 1, True

    def end(self, bracket: str) -> None:
        self.depth -= 1
        self.out.write(("" if self.first else "\n" + "  " * self.depth) + bracket)
        self.first = False
        if self.depth == 0:
            self.out.write("\n")


# --- summary


def _labels(n: int) -> list[str]:
    """Labels of the upper borders of the first n buckets."""
    return [C.format_size(0 if k == 0 else C.MIB << (k - 1)) for k in range(n)]


def _filled(buckets: list[int]) -> int:
    """Buckets up to the highest that isn't empty, the first at least."""
    return max([k + 1 for k, n in enumerate(buckets) if n], default=1)


def _matching(name: Column, user: str | None) -> Column:
    return name.rlike(user) if user else F.lit(True)


def summary_text(nodes: DataFrame, start: str, out: TextIO, user: str | None = None, sort: str = "fs") -> None:
    """Totals overall, by group and by user, least first; user is found anywhere in names and selects users only."""
    stats = R.statistics(nodes).cache()
    overall = stats.where("level = 'overall'").first()
    sizes = {r.level: r.n for r in stats.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = _filled(overall.buckets)
    widths = [max(len(label), len(str(count))) for label, count in zip(_labels(n), overall.buckets)]
    cells = lambda values: " ".join(f"{v:>{w}}" for v, w in zip(values, widths))
    mb = lambda size: size // C.MIB
    title = f"HDFS Summary : {start}"
    blank = OVERALL_BLANK + cells(_labels(n))
    out.write(f"\n{title}\n{'-' * len(title)}\n\n{OVERALL_HEAD}\n{blank}\n{'-' * len(blank)}\n")
    tail = lambda r: f"{r.links:>9} | {r.files:>10} | {mb(r['size']):>9} | {mb(r.consumed):>9} | {r.blocks:>9} | {cells(r.buckets[:n])}\n"
    out.write(f"{sizes.get('group', 0):>8} | {sizes.get('user', 0):>11} | {overall.dirs:>12} | {tail(overall)}")
    for level, head in (("group", "By group:"), ("user", "By user:")):
        rows = stats.where((F.col("level") == level) & (_matching(F.col("name"), user) if level == "user" else F.lit(True)))
        blank = BY_BLANK + cells(_labels(n))
        out.write(f"\n{head:<14}{rows.count():>8}{BY_HEAD}\n{blank}\n{'-' * len(blank)}\n")
        for r in rows.orderBy(SORTS[sort], "name").toLocalIterator():
            out.write(f"{r.name:>22} | {r.dirs:>12} | {tail(r)}")
    stats.unpersist()


def summary_csv(nodes: DataFrame, out: TextIO) -> None:
    level = F.when(F.col("level") == "overall", 0).when(F.col("level") == "group", 1).otherwise(2)
    rows = R.statistics(nodes).orderBy(level, "name").toLocalIterator()
    write_csv(([r.level.capitalize(), r.name, r.dirs, r.links, r.files, r["size"], r.blocks, f"[{', '.join(map(str, r.buckets))}]"] for r in rows), out, SUMMARY_CSV)


def _stats_json(r: Row, name: str | None) -> dict:
    labels = _labels(_filled(r.buckets))
    totals = {"sumFiles": r.files, "sumDirectories": r.dirs, "sumSymLinks": r.links, "sumBlocks": r.blocks, "sumFileSize": r["size"], "sumConsumedFileSize": r.consumed}
    return {**({name: r.name} if name else {}), **totals, "fileSizeBuckets": [{label: count} for label, count in zip(labels, r.buckets)]}


def summary_json(nodes: DataFrame, start: str, out: TextIO) -> None:
    stats = R.statistics(nodes).cache()
    js = JsonStream(out)
    js.begin("{")
    for level, key, name in (("group", "groupStats", "groupName"), ("user", "userStats", "userName")):
        js.begin("{", key)
        for r in stats.where(F.col("level") == level).orderBy("name").toLocalIterator():
            js.value(_stats_json(r, name), r.name)
        js.end("}")
    js.value(_stats_json(stats.where("level = 'overall'").first(), None), "overallStats")
    js.value(start, "dirPath")
    js.end("}")
    stats.unpersist()


# --- small files


def _full(user: str | None) -> Column:
    return F.col("owner").rlike(rf"\A(?:{user})\z") if user else F.lit(True)


def _counts(nodes: DataFrame, limit: int) -> DataFrame:
    """Small files by owner (empty where it isn't known) and directory."""
    return R.small_files(nodes, limit).withColumn("owner", F.coalesce("owner", F.lit(""))).groupBy("owner", "parent_path").agg(F.count(F.lit(1)).alias("small_files"))


def _sums(by: DataFrame, user: str | None) -> tuple[int, int]:
    """Small files of all users, and of those whose whole name matches."""
    row = by.agg(F.coalesce(F.sum("small_files"), F.lit(0)), F.coalesce(F.sum(F.when(_full(user), F.col("small_files"))), F.lit(0))).first()
    return row[0], row[1]


def _users(by: DataFrame, user: str | None) -> DataFrame:
    return by.where(_full(user)).groupBy("owner").agg(F.sum("small_files").cast("long").alias("small_files")).orderBy(F.desc("small_files"), "owner")


def small_files_text(nodes: DataFrame, starts: list[str], out: TextIO, limit: int = R.SMALL, user: str | None = None, top: int = 10) -> None:
    """Directories and users with most small files, counts rolled up to /; user must match a whole name and leaves the overall part as it is."""
    by = _counts(nodes, limit).cache()
    overall, filtered = _sums(by, user)
    out.write(f"\nSmall files report (< {C.format_size(limit)})\n\n")
    if overall == filtered:
        out.write(f"Overall small files : {overall}\n\n")
    else:
        out.write(f"Overall small files         : {overall}\nUser (filtered) small files : {filtered}\n\n")
    head = f"#Small files  | Path (top {top}) "
    out.write(f"{head}\n{'-' * len(head)}\n")
    width = max(len(str(overall)), len("#Small files "))
    for r in R.roll_up(by, "small_files").orderBy(F.desc("small_files"), "path").limit(top).collect():  # top rows
        out.write(f"{r.small_files:>{width}} | {r.path}\n")
    out.write("\n")
    users = _users(by, user)
    layout = users.agg(F.max("small_files").alias("most"), F.max(F.length("owner")).alias("longest")).first()
    if layout.most is None:
        out.write(f"No users found in directory paths [{', '.join(starts)}]\n")
        by.unpersist()
        return
    width, names = max(len(str(layout.most)), len("#Small files")), max(layout.longest, len("Username"))
    out.write(f"{'Username':<{names}} | {'#Small files':<{width}} | %\n{'-' * (names + width + 16)}\n")
    for r in users.toLocalIterator():
        out.write(f"{r.owner:<{names}} | {r.small_files:>{width}} | {_percent(r.small_files, overall)}\n")
    label = f"Small files hotspots (top {top} count/path)"
    line = "-" * (names + 3 + len(label))
    out.write(f"\n{'Username':<{names}} | {label}\n{line}\n")
    last = None
    for r in hotspots(by, user, top).orderBy(F.desc("all"), "owner", "rank").toLocalIterator():
        if last not in (None, r.owner):
            out.write(f"{line}\n")
        out.write(f"{r.owner if r.owner != last else '':<{names}} | {r.small_files:>{width}} | {r.path}\n")
        last = r.owner
    out.write(f"{line}\n")
    by.unpersist()


def _percent(part: int, whole: int) -> str:
    """One decimal, half up."""
    tenths = (2000 * part + whole) // (2 * whole)
    return f"{tenths // 10}.{tenths % 10}%"


def hotspots(by: DataFrame, user: str | None = None, top: int = 10) -> DataFrame:
    """(owner, path, small_files, rank, all) of the top directories, rolled up, of the users with most small files (top, 10 at most)."""
    first = _users(by, user).limit(min(top, 10)).withColumnRenamed("small_files", "all")
    return R.top_per_key(R.roll_up(by.join(first, "owner"), "small_files", ("owner", "all")), "owner", "small_files", top)


def direct_hotspots(by: DataFrame, user: str | None = None, top: int = 10) -> DataFrame:
    """(owner, path, small_files, rank) of each user's top directories by what lies in them directly."""
    return R.top_per_key(by.where(_full(user)).withColumnRenamed("parent_path", "path"), "owner", "small_files", top)


def small_files_csv(nodes: DataFrame, out: TextIO, limit: int = R.SMALL, user: str | None = None, top: int = 10) -> None:
    """Overall, users and hotspots; directories by what lies in them directly."""
    by = _counts(nodes, limit).cache()

    def rows() -> Iterator[list]:
        yield ["Overall", "/", "", _sums(by, user)[0]]
        for r in _users(by, user).toLocalIterator():
            yield ["User", r.owner, "", r.small_files]
        for r in direct_hotspots(by, user, top).orderBy("owner", "rank").toLocalIterator():
            yield ["Hotspot", r.owner, r.path, r.small_files]

    write_csv(rows(), out, SMALL_CSV)
    by.unpersist()


def small_files_json(nodes: DataFrame, out: TextIO, limit: int = R.SMALL, user: str | None = None) -> None:
    """All direct counts by user and directory, and by directory."""
    by = _counts(nodes, limit).cache()
    overall, filtered = _sums(by, user)
    js = JsonStream(out)
    js.begin("{")
    js.begin("{", "userToReport")
    last, total = None, 0

    def close() -> None:
        js.end("}")
        js.value(total, "sumSmallFiles")
        js.end("}")

    for r in by.where(_full(user)).orderBy("owner", "parent_path").toLocalIterator():
        if r.owner != last:
            if last is not None:
                close()
            js.begin("{", r.owner)
            js.value(r.owner, "userName")
            js.begin("{", "pathToCounter")
            last, total = r.owner, 0
        js.value(r.small_files, r.parent_path)
        total += r.small_files
    if last is not None:
        close()
    js.end("}")
    js.begin("{", "pathToCounter")
    for r in by.groupBy("parent_path").agg(F.sum("small_files").alias("n")).orderBy("parent_path").toLocalIterator():
        js.value(r.n, r.parent_path)
    js.end("}")
    js.value(filtered, "sumUserSmallFiles")
    js.value(overall, "sumOverallSmallFiles")
    js.end("}")
    by.unpersist()


# --- usage


def usage(nodes: DataFrame, user: str, age_ms: int = 0, now: datetime | None = None) -> DataFrame:
    """(path, size) of a user's files by directory, rolled up to /, largest first; files last changed longer than age_ms ago."""
    before = int((now or datetime.now()).timestamp() * 1000) - age_ms if age_ms > 0 else None
    return R.roll_up(R.user_usage(nodes, user, before), "size").orderBy(F.desc("size"), "path")


def usage_text(nodes: DataFrame, start: str, out: TextIO, user: str, age_ms: int = 0, limit: int | None = None, now: datetime | None = None) -> None:
    now = now or datetime.now()
    older = f", last modification older {(now - timedelta(milliseconds=age_ms)).isoformat(timespec='milliseconds')}" if age_ms > 0 else ""
    out.write(f"\nSize report (user={user}, start dir={start}{older})\n\n")
    rows = usage(nodes, user, age_ms, now).cache()
    width = rows.agg(F.max(F.length("path"))).first()[0]
    if width is None:
        out.write("No data found\n")
    for r in (rows if limit is None else rows.limit(limit)).toLocalIterator():
        out.write(f"{r.path:<{width}} | {C.format_size(r['size'])}\n")
    rows.unpersist()


def usage_csv(nodes: DataFrame, out: TextIO, user: str, age_ms: int = 0) -> None:
    write_csv(usage(nodes, user, age_ms).toLocalIterator(), out, USAGE_CSV)


def usage_json(nodes: DataFrame, out: TextIO, user: str, age_ms: int = 0) -> None:
    js = JsonStream(out)
    js.begin("{")
    js.begin("{", "pathToSize")
    for r in usage(nodes, user, age_ms).toLocalIterator():
        js.value(r["size"], r.path)
    js.end("}")
    js.end("}")


# --- paths


def _type_counts(found: DataFrame) -> tuple[int, int, int]:
    n = {r.type: r.n for r in found.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get("FILE", 0), n.get("DIRECTORY", 0), n.get("SYMLINK", 0)


def counted(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def paths_text(found: DataFrame, starts: list[str], out: TextIO, user: str | None = None) -> None:
    """found is what reports.paths gives."""
    where = f"path={starts[0]}" if len(starts) == 1 else f"paths=[{', '.join(starts)}]"
    title = f"Path report ({where}, {f'user=~{user}' if user else 'no filter'}) :"
    files, dirs, links = _type_counts(found)
    counts = f"{counted(files, 'file', 'files')}, {counted(dirs, 'directory', 'directories')} and {counted(links, 'symlink', 'symlinks')}"
    out.write(f"\n{title}\n{'-' * len(title)}\n\n{counts}\n\n")
    found = found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("owner", "grp")})
    widths = found.agg(F.max(F.length("owner")).alias("owner"), F.max(F.length("grp")).alias("grp")).first()
    for r in found.select("path", "owner", "grp", C.type_char(F.col("type")).alias("kind"), C.symbolic_mode(F.col("mode")).alias("mode")).orderBy("path").toLocalIterator():
        out.write(f"{r.kind}{r.mode} {r.owner:<{widths.owner}} {r.grp:<{widths.grp}} {r.path}\n")


def paths_csv(found: DataFrame, out: TextIO) -> None:
    write_csv(R.path_rows(found).orderBy("path").toLocalIterator(), out, PATH_CSV)


def paths_json(found: DataFrame, out: TextIO) -> None:
    js = JsonStream(out)
    js.begin("{")
    js.begin("[", "results")
    for r in found.select("path", F.col("owner").alias("user"), F.col("grp").alias("group"), C.type_letter(F.col("type")).alias("type"), C.symbolic_mode(F.col("mode")).alias("permission")).orderBy("path").toLocalIterator():
        js.value(r.asDict())
    js.end("]")
    for name, n in zip(("fileCount", "dirCount", "symLinkCount"), _type_counts(found)):
        js.value(n, name)
    js.end("}")


# --- single nodes


def quoted(text: str) -> str:
    """Text between quotes as bytes: printable ASCII but quotes and backslashes, other bytes in octal."""
    named = {0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t", 0x22: '\\"', 0x27: "\\'", 0x5C: "\\\\"}
    return '"' + "".join(named.get(b) or (chr(b) if 0x20 <= b < 0x7F else f"\\{b:03o}") for b in text.encode()) + '"'


def _fields(pairs: list[tuple[str, object]], indent: str = "  ") -> str:
    """Lines name: value; values that are there, lists one by one and nested ones in braces."""
    out = ""
    for name, value in pairs:
        if isinstance(value, list):
            out += "".join(f"{indent}{name} {{\n{_fields(v, indent + '  ')}{indent}}}\n" for v in value)
        elif value is not None:
            out += f"{indent}{name}: {value}\n"
    return out


def inode_text(r: Row) -> str:
    """A node as a message in text form, in the order of the format's fields; quotas are unsigned."""
    unsigned = lambda n: None if n is None else n % (1 << 64)
    if r.type == "FILE":
        blocks = [[("blockId", b.block_id), ("genStamp", b.gen_stamp), ("numBytes", b.num_bytes)] for b in r.blocks or []]
        body = [("replication", r.replication), ("modificationTime", r.mtime_ms), ("accessTime", r.atime_ms), ("preferredBlockSize", r.preferred_block_size), ("permission", r.permission), ("blocks", blocks), ("storagePolicyID", r.storage_policy_id), ("erasureCodingPolicyID", r.ec_policy_id)]
    elif r.type == "DIRECTORY":
        body = [("modificationTime", r.mtime_ms), ("nsQuota", unsigned(r.ns_quota)), ("dsQuota", unsigned(r.ds_quota)), ("permission", r.permission)]
    else:
        body = [("permission", r.permission), ("target", quoted(r.target or "")), ("modificationTime", r.mtime_ms), ("accessTime", r.atime_ms)]
    return f"type: {r.type}\nid: {r.id}\nname: {quoted(r.name)}\n{r.type.lower()} {{\n{_fields(body)}}}\n"


def inode_json_columns() -> Column:
    """A node as a JSON text by type: absent numbers are 0, atime is the time of change."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias
    common = [F.col("id"), F.col("name"), F.lower("type").alias("type"), C.permission_text(F.col("owner"), F.col("grp"), F.col("mode")).alias("permission")]
    times = [zero("mtime_ms")("mtime"), zero("mtime_ms")("atime")]
    file = F.struct(*common, *times, zero("replication")("replication"), zero("preferred_block_size")("preferredBlockSize"), zero("storage_policy_id")("storagePolicyID"), zero("ec_policy_id")("erasureCodingPolicyID"))
    directory = F.struct(*common, zero("ns_quota")("nsQuota"), zero("ds_quota")("dsQuota"), *times)
    link = F.struct(*common, F.coalesce("target", F.lit("")).alias("target"), *times)
    return F.when(F.col("type") == "FILE", F.to_json(file)).when(F.col("type") == "DIRECTORY", F.to_json(directory)).when(F.col("type") == "SYMLINK", F.to_json(link))


def not_found(arg: str) -> str:
    return f"Can not find INode by id/path '{arg}'"


def inodes_text(found: DataFrame, out: TextIO) -> None:
    """found is what lookups.resolve_arguments gives; a row an argument."""
    for r in found.orderBy("nth").collect():  # one row an argument
        out.write(f"{inode_text(r)}\n" if r.id is not None else f"{not_found(r.arg)}\n")


def inodes_csv(found: DataFrame, out: TextIO, err: TextIO) -> None:
    rows = found.select("nth", "arg", "id", "name", "type").orderBy("nth").collect()  # one row an argument
    write_csv(([r.id, r.name, r.type] if r.id is not None else [r.arg, "- ERR -", "- ERR -"] for r in rows), out, INODE_CSV)
    for r in rows:
        if r.id is None:
            err.write(f"{not_found(r.arg)}\n")


def inodes_json(found: DataFrame, out: TextIO) -> None:
    js = JsonStream(out)
    js.begin("{")
    js.begin("[", "results")
    for r in found.select("nth", "arg", inode_json_columns().alias("inode")).orderBy("nth").collect():  # one row an argument
        js.value({"inode_arg": r.arg, **({"error": not_found(r.arg)} if r.inode is None else {"inode": json.loads(r.inode)})})
    js.end("]")
    js.end("}")
