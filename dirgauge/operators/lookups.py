"""Lookups of single nodes and their neighbours, with errors for what isn't there.

Each reads the nodes table with a filter on path or id, so the scan reads only the row
groups that can hold them. Rows that come to the driver are those of one node or one
directory's children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

STICKY = 0o1000


def plain(path: str) -> str:
    """path with one slash for several and none at the end; ValueError unless it begins with a slash."""
    if not path.startswith("/"):
        raise ValueError(f"A path begins with /, not {path!r}")
    return "/" + "/".join(p for p in path.split("/") if p)


class Namespace:
    """Lookups over nodes (see sources) and edges(parent_id, child_id, pos), if there are any."""

    def __init__(self, nodes: DataFrame, edges: DataFrame | None = None) -> None:
        self.nodes = nodes
        self.edges = edges if edges is not None else nodes.where("path <> '/'").select("parent_id", F.col("id").alias("child_id"), F.col("id").alias("pos"))

    def by_id(self, id_: int) -> Row:
        """The node, or KeyError; of a node with several paths the one of the first path."""
        found = self.nodes.where(F.col("id") == id_).orderBy("path").limit(1).collect()
        if not found:
            raise KeyError(f"Can not find inode by id {id_}")
        return found[0]

    def by_path(self, path: str) -> Row:
        """The node, or FileNotFoundError; ValueError for a path that isn't absolute."""
        found = self.nodes.where(F.col("path") == plain(path)).limit(1).collect()
        if not found:
            raise FileNotFoundError(path)
        return found[0]

    def exists(self, path: str) -> bool:
        return not self.nodes.where(F.col("path") == plain(path)).isEmpty()

    def child_directories(self, path: str, keep: Column | None = None) -> list[str]:
        """Paths of the directories in a directory, in order; keep: a condition on their columns."""
        at = self.by_path(path).path
        found = self.nodes.where((F.col("parent_path") == at) & (F.col("type") == "DIRECTORY") & (F.col("path") != "/"))
        return [r.path for r in (found if keep is None else found.where(keep)).select("path").orderBy("path").toLocalIterator()]

    def files(self, path: str) -> DataFrame:
        """The files in a directory; NotADirectoryError for another node."""
        node = self.by_path(path)
        if node.type != "DIRECTORY":
            raise NotADirectoryError(path)
        return self.nodes.where((F.col("parent_path") == node.path) & (F.col("type") == "FILE"))

    def child_ids(self, id_: int) -> list[int]:
        """Ids of a node's children in the image's order, plain ones before references; none for a leaf."""
        return [r.child_id for r in self.edges.where(F.col("parent_id") == id_).orderBy("pos", "child_id").toLocalIterator()]

    def n_children(self, id_: int) -> int:
        return self.edges.where(F.col("parent_id") == id_).count()

    def has_children(self, node: int | str) -> bool:
        """Of a node by id or path."""
        id_ = self.by_path(node).id if isinstance(node, str) else node
        return not self.edges.where(F.col("parent_id") == id_).isEmpty()

    def permission(self, node: int | str) -> str:
        """user:group:octal mode of a node by id or path."""
        row = self.by_path(node) if isinstance(node, str) else self.by_id(node)
        return f"{row.owner or ''}:{row.grp or ''}:{row['mode']:04o}"

    def acl_entries(self, path: str) -> list[Row]:
        """Entries (scope, type, name, perm) of a file or directory; none for a link."""
        return list(self.by_path(path)["acl"] or [])

    def acl_status(self, path: str) -> dict:
        node = self.by_path(path)
        return {"owner": node.owner, "group": node.grp, "entries": list(node["acl"] or []), "mode": node["mode"], "sticky": bool(node["mode"] & STICKY)}


def visit(nodes: DataFrame, on_file=None, on_directory=None, on_symlink=None) -> DataFrame | None:
    """The union of what each function makes of the nodes of its type, a DataFrame each; None without functions.

    The order of nodes isn't fixed, and one function's result doesn't reach another.
    """
    out = None
    for kind, make in (("FILE", on_file), ("DIRECTORY", on_directory), ("SYMLINK", on_symlink)):
        if make is not None:
            made = make(nodes.where(F.col("type") == kind))
            out = made if out is None else out.unionByName(made)
    return out


def resolve_arguments(nodes: DataFrame, args: list[str]) -> DataFrame:
    """One row per argument: nth, arg, and the node's columns (null where there is none).

    A number is an id, anything else a path; of a node with several paths the first counts.
    """
    spark = nodes.sparkSession
    number = lambda a: a.isascii() and a.isdigit() and int(a) < 1 << 63
    kinds = [(k, a, int(a) if number(a) else None, None if number(a) else (plain(a) if a.startswith("/") else a)) for k, a in enumerate(args)]
    asked = spark.createDataFrame(kinds, "nth int, arg string, _id bigint, _path string")
    wanted = nodes.where(F.col("id").isin([k[2] for k in kinds if k[2] is not None]) | F.col("path").isin([k[3] for k in kinds if k[3] is not None]))
    first = wanted.withColumn("_first", F.min("path").over(Window.partitionBy("id"))).where((F.col("path") == F.col("_first")) | F.col("path").isin([k[3] for k in kinds if k[3] is not None]))
    found = asked.join(first, ((F.col("_id") == first.id) & (first.path == first._first)) | (F.col("_path") == first.path), "left")
    return found.drop("_id", "_path", "_first")

