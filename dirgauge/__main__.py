"""Command line: python -m dirgauge [options] FILE [summary | smallfiles | inode | path | userusage] ...

FILE is a checkpoint image, or a folder of the tables that sources/tables.py reads.
"""

from __future__ import annotations

import argparse
import re
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from dirgauge import __version__
from dirgauge.functions.columns import parse_age, parse_size
from dirgauge.operators import lookups, reports
from dirgauge.render import text
from dirgauge.sources import image, tables


def load(spark: SparkSession, file: str) -> DataFrame:
    """Nodes of an image or of a folder of tables."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    files = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(store):
        raise FileNotFoundError(f"{file} doesn't exist")
    return tables.nodes(spark, file) if files.getFileStatus(store).isDirectory() else image.nodes(spark, file)


def summary(nodes: DataFrame, args: argparse.Namespace, out: TextIO, err: TextIO) -> None:
    for start in args.path:
        part = reports.subtree(nodes, start)
        if args.output == "csv":
            text.summary_csv(part, out)
        elif args.output == "json":
            text.summary_json(part, start, out)
        else:
            text.summary_text(part, start, out, args.user, args.sort)


def smallfiles(nodes: DataFrame, args: argparse.Namespace, out: TextIO, err: TextIO) -> None:
    for start in args.path:
        part = reports.subtree(nodes, start)
        if args.output == "csv":
            text.small_files_csv(part, out, args.limit, args.user, args.hotspots)
        elif args.output == "json":
            text.small_files_json(part, out, args.limit, args.user)
        else:
            text.small_files_text(part, args.path, out, args.limit, args.user, args.hotspots)


def path(nodes: DataFrame, args: argparse.Namespace, out: TextIO, err: TextIO) -> None:
    found = reports.paths(nodes, tuple(args.path), args.user)
    if args.output == "csv":
        text.paths_csv(found, out)
    elif args.output == "json":
        text.paths_json(found, out)
    else:
        text.paths_text(found, args.path, out, args.user)


def userusage(nodes: DataFrame, args: argparse.Namespace, out: TextIO, err: TextIO) -> None:
    for start in args.path:
        part = reports.subtree(nodes, start)
        if args.output == "csv":
            text.usage_csv(part, out, args.name, args.age)
        elif args.output == "json":
            text.usage_json(part, out, args.name, args.age)
        else:
            text.usage_text(part, start, out, args.name, args.age, args.limit)


def inode(nodes: DataFrame, args: argparse.Namespace, out: TextIO, err: TextIO) -> None:
    found = lookups.resolve_arguments(nodes, args.arg)
    if args.output == "csv":
        text.inodes_csv(found, out, err)
    elif args.output == "json":
        text.inodes_json(found, out)
    else:
        text.inodes_text(found, out)


REPORTS = {"summary": summary, "smallfiles": smallfiles, "sf": smallfiles, "inode": inode, "i": inode, "path": path, "p": path, "userusage": userusage, "uu": userusage}


def _checked(convert, what: str):
    """convert as an argument's type whose message reaches the user."""

    def run(given: str):
        try:
            return convert(given)
        except (ValueError, re.error) as e:
            raise argparse.ArgumentTypeError(f"{what}: {e}") from e

    return run


def _pattern(given: str) -> str:
    re.compile(given)
    return given


def _starts(given: str) -> list[str]:
    return [lookups.plain(p) for p in given.split(",") if p]


class _Starts(argparse.Action):
    def __call__(self, parser, namespace, values, option=None):
        setattr(namespace, self.dest, [*(getattr(namespace, self.dest) or []), *values])


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="dirgauge", description="Reports on users and groups of a file system's namespace.")
    out.add_argument("file", metavar="FILE", help="checkpoint image, or a folder of tables")
    out.add_argument("-p", "--path", action=_Starts, type=_checked(_starts, "paths"), help="directories to start at, with commas between (default: /)")
    out.add_argument("-fun", "--filter-by-user", dest="user", type=_checked(_pattern, "pattern"), help="pattern of user names")
    out.add_argument("-V", "--version", action="version", version=f"Version {__version__}")

    def shared(p: argparse.ArgumentParser, **more) -> argparse.ArgumentParser:
        p.add_argument("-o", "--output", choices=["txt", "csv", "json"], help="output format (default: txt)", **(more or {"default": "txt"}))
        p.add_argument("-v", dest="verbose", action="count", help="show where an error comes from; -vv also Spark's own log", **(more or {"default": 0}))
        return p

    shared(out)
    commands = out.add_subparsers(dest="report", metavar="COMMAND")
    add = lambda name, help_, *aliases: shared(commands.add_parser(name, aliases=list(aliases), help=help_), default=argparse.SUPPRESS)
    sorted_ = add("summary", "usage by group and user (what is done without a command)")
    small = add("smallfiles", "small files by directory and user", "sf")
    one = add("inode", "details of nodes", "i")
    add("path", "all paths", "p")
    used = add("userusage", "directories that a user fills most", "uu")
    sorted_.add_argument("-s", "--sort", choices=list(text.SORTS), default="fs", help="by file size, files, directories or blocks (default: fs)")
    small.add_argument("--fsl", "-fileSizeLimit", dest="limit", type=_checked(parse_size, "size"), default=reports.SMALL, help="bytes that small files have less than, such as 2MiB")
    small.add_argument("--uphl", "-userPathHotspotLimit", dest="hotspots", type=int, default=10, help="directories shown for each user (default: 10)")
    one.add_argument("arg", nargs="+", help="an id or a path")
    used.add_argument("name", metavar="USER", help="a user's name, whatever its case")
    used.add_argument("-a", "--age", type=_checked(parse_age, "age"), default=0, help="files last changed longer ago, such as 60d, 3y, 12h")
    used.add_argument("-l", "--limit", type=int, help="directories shown in text")
    out.set_defaults(sort="fs")
    return out


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    out = parser().parse_args(given)
    out.path = out.path or ["/"]
    out.report = out.report or "summary"
    return out


def run(spark: SparkSession, args: argparse.Namespace, out: TextIO, err: TextIO = sys.stderr) -> int:
    """Write the report to out; 1 and a message to err if it fails."""
    try:
        nodes = load(spark, args.file)
        if args.report not in ("inode", "i"):
            space = lookups.Namespace(nodes)
            for start in args.path:
                if space.by_path(start).type != "DIRECTORY":
                    raise NotADirectoryError(f"{start} is no directory")
        REPORTS[args.report](nodes, args, out, err)
    except Exception as e:
        if args.verbose:
            raise
        print(f"{type(e).__name__ if not str(e) or isinstance(e, FileNotFoundError) else ''} {e}\n(-v shows more)".strip(), file=err)
        return 1
    return 0


if __name__ == "__main__":
    given = arguments()
    session = SparkSession.builder.appName("dirgauge").getOrCreate()
    session.sparkContext.setLogLevel("INFO" if given.verbose > 1 else "WARN")
    sys.exit(run(session, given, sys.stdout))
