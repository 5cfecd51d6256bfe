"""A Spark data source for file-system checkpoint images (format name: dirgauge_image).

An image holds an 8-byte magic, sections, a summary that lists the sections with their
offsets and codec, and the summary's length in the last four bytes. Records are protobuf
messages with a varint length before each. Field numbers come from the public schema; the
format was tested on images written here only, as no other is at hand.

    spark.dataSource.register(ImageSource)
    spark.read.format("dirgauge_image").option("section", "INODE").load(path)

Sections: STRING_TABLE, INODE_REFERENCE, INODE, INODE_DIR, and INODE_ID, which decodes no
more of a node than its id. Without a codec the inode section is read in parts: near each
cut, a place from which many records follow each other is taken for a record's begin, and
the part before must end exactly there, or the read fails; so the driver reads a little at
each cut only. A compressed section is one stream, unpacked piece by piece; load() writes
what it reads as Parquet once. Snapshots, cache pools, tokens and files under construction
aren't read. Files are opened with Arrow's stores.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dirgauge.functions.columns import consumed_size, file_size, unpack_permission
from dirgauge.plans import store
from dirgauge.plans.tree import place

MAGIC = b"HDFSIMG1"
PART_BYTES = 32 * 1024 * 1024
#: Records that must follow each other at a cut, and bytes of a stream that are held at once, about.
CHAIN, PIECE = 64, 1 << 20
#: Spaces of numbers of names, fixed values of the format.
SPACES = {"USER": 1, "GROUP": 2}
#: The root's id, a fixed value of the format.
ROOT = 16385
KINDS = {1: "FILE", 2: "DIRECTORY", 3: "SYMLINK"}
#: Access-control entries are packed in 32 bits, fixed layout: permission 3, type 2, scope 1 bits, then the name's id in 24.
ACL_TYPES, ACL_SCOPES = ["USER", "GROUP", "MASK", "OTHER"], ["ACCESS", "DEFAULT"]

SCHEMAS = {
    "STRING_TABLE": "id bigint, str string, space int",
    "INODE_REFERENCE": "ref_idx int, inode_id bigint",
    "INODE": "id bigint, type string, name string, permission bigint, mtime_ms bigint, atime_ms bigint, replication int, preferred_block_size bigint, blocks array<struct<block_id:bigint,gen_stamp:bigint,num_bytes:bigint>>, storage_policy_id int, ec_policy_id int, ns_quota bigint, ds_quota bigint, target string, acl array<struct<scope:string,type:string,name_id:int,perm:int>>",
    "INODE_ID": "id bigint",
    "INODE_DIR": "parent_id bigint, children array<bigint>, ref_children array<int>",
}


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7
        if shift >= 70:
            raise ValueError("Malformed varint")


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fields(data: bytes) -> dict[int, list]:
    """A message's values by field number, in order; unknown fields are there too."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<Q", data, at)[0], at + 8
        elif kind == 5:
            value, at = struct.unpack_from("<I", data, at)[0], at + 4
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"Unknown wire type {kind}")
        out.setdefault(tag >> 3, []).append(value)
    return out


def numbers(values: list) -> list[int]:
    """A repeated number field, packed or not."""
    out = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            n, at = varint(v, at)
            out.append(n)
    return out


def delimited(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of pieces; one that is cut off raises."""
    data, at = b"", 0
    for piece in pieces:
        data, at = data[at:] + piece, 0
        while at < len(data):
            try:
                size, begin = varint(data, at)
            except IndexError:
                break
            if begin + size > len(data):
                break
            yield data[begin : begin + size]
            at = begin + size
    if at < len(data):
        raise ValueError("The last record is cut off")


def _begins(data: bytes, at: int) -> int | None:
    """Where the record after the inode that begins at at begins, or None if there is none; IndexError where data ends too early."""
    size, begin = varint(data, at)
    if not 5 <= size < 1 << 31 or data[begin] != 0x08 or data[begin + 1] not in KINDS or data[begin + 2] != 0x10:
        return None
    # a name or the type's own part follows the id; in a block, which begins like an inode, a number does
    return begin + size if data[varint(data, begin + 3)[1]] in (0x1A, 0x1A + 8 * data[begin + 1]) else None


def first_record(data: bytes) -> int | None:
    """The first place in data from which CHAIN inodes follow each other."""
    for at in range(len(data)):
        place, met = at, 0
        try:
            while met < CHAIN and place is not None and place < len(data):
                place, met = _begins(data, place), met + 1
        except (IndexError, ValueError):
            continue
        if place is not None and met == CHAIN:
            return at
    return None


def _open(path: str):
    """A file for random reads, from any store that Arrow knows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def summary(path: str) -> tuple[str, dict[str, tuple[int, int]]]:
    """The image's codec ('' for none) and its sections' (offset, length)."""
    with _open(path) as f:
        size = f.size()
        if size < 12 or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a checkpoint image")
        length = struct.unpack(">I", f.read_at(4, size - 4))[0]
        top = fields(next(delimited(iter([f.read_at(length, size - 4 - length)]))))
    sections = {}
    for raw in top.get(4, []):
        s = fields(raw)
        sections[s[1][0].decode()] = (s[3][0], s[2][0])
    return top.get(3, [b""])[0].decode(), sections


class _Range(io.RawIOBase):
    """A range of an open file as a stream."""

    def __init__(self, file, offset: int, length: int) -> None:
        self.file, self.at, self.end = file, offset, offset + length

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.file.read_at(min(len(into), self.end - self.at), self.at) if self.at < self.end else b""
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def _pieces(stream, codec: str) -> Iterator[bytes]:
    """The unpacked bytes of a stream, some at a time."""
    name = codec.rsplit(".", 1)[-1]
    if name in ("DefaultCodec", "DeflateCodec"):
        unpack = zlib.decompressobj()
        while piece := stream.read(PIECE):
            while piece:
                yield unpack.decompress(piece, PIECE)
                piece = unpack.unconsumed_tail
        yield unpack.flush()
        return
    if name == "GzipCodec":
        stream = gzip.GzipFile(fileobj=stream)
    elif name == "ZStandardCodec":
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    elif codec:
        raise ValueError(f"Codec {codec} isn't supported")
    while piece := stream.read(PIECE):
        yield piece


def _id(raw: bytes) -> tuple[int]:
    """A node's id alone: type and id are its first two fields."""
    return (varint(raw, 3)[0],) if raw[:1] == b"\x08" and raw[2:3] == b"\x10" else (fields(raw)[2][0],)


def _inode(raw: bytes) -> tuple:
    top = fields(raw)
    kind, one = KINDS[top[1][0]], lambda m, k, default=None: m[k][0] if k in m else default
    name = one(top, 3, b"").decode("utf-8", "replace")
    body = fields(one(top, {"FILE": 4, "DIRECTORY": 5, "SYMLINK": 6}[kind], b""))
    entries = lambda k: [(ACL_SCOPES[(e >> 5) & 1], ACL_TYPES[(e >> 3) & 3], e >> 8, e & 7) for x in body.get(k, []) for p in fields(x).get(1, []) for e in ([p] if isinstance(p, int) else struct.unpack(f"<{len(p) // 4}I", p))]
    if kind == "FILE":
        blocks = [(one(b, 1, 0), one(b, 2, 0), one(b, 3, 0)) for b in map(fields, body.get(6, []))]
        return (top[2][0], kind, name, signed(one(body, 5, 0)), one(body, 2), one(body, 3), one(body, 1), one(body, 4), blocks, one(body, 10), one(body, 12), None, None, None, entries(8))
    if kind == "DIRECTORY":
        quota = lambda k: signed(one(body, k)) if k in body else None
        return (top[2][0], kind, name, signed(one(body, 4, 0)), one(body, 1), None, None, None, None, None, None, quota(2), quota(3), None, entries(5))
    return (top[2][0], kind, name, signed(one(body, 1, 0)), one(body, 3), one(body, 4), None, None, None, None, None, None, None, one(body, 2, b"").decode("utf-8", "replace"), [])


@dataclass
class Part(InputPartition):
    offset: int
    length: int
    head: bool


class ImageReader(DataSourceReader):
    def __init__(self, path: str, section: str) -> None:
        self.path, self.section = path, section
        self.codec, sections = summary(path)
        if section not in SCHEMAS:
            raise ValueError(f"{section} isn't one of {', '.join(SCHEMAS)}")
        own = "INODE" if section == "INODE_ID" else section
        if own not in sections:
            raise ValueError(f"No section {section} among {', '.join(sections)}")
        self.offset, self.length = sections[own]

    def partitions(self) -> list[Part]:
        if self.codec or self.section not in ("INODE", "INODE_ID") or self.length <= PART_BYTES:
            return [Part(self.offset, self.length, True)]
        end, cuts = self.offset + self.length, [self.offset]
        with _open(self.path) as f:
            for near in range(self.offset + PART_BYTES, end, PART_BYTES):
                width, found = PIECE, None
                while near > cuts[-1] and (found := first_record(f.read_at(min(width, end - near), near))) is None and near + width < end:
                    width *= 4
                if found is not None:
                    cuts.append(near + found)
        return [Part(a, b - a, a == self.offset) for a, b in zip(cuts, [*cuts[1:], end], strict=True)]

    def read(self, part: Part) -> Iterator[tuple]:
        try:
            with _open(self.path) as f:
                yield from self._rows(delimited(_pieces(io.BufferedReader(_Range(f, part.offset, part.length), PIECE), self.codec)), part.head)
        except Exception as e:
            raise ValueError(f"Section {self.section} of {self.path} can't be read: {e}") from e

    def _rows(self, records: Iterator[bytes], head: bool) -> Iterator[tuple]:
        if self.section == "STRING_TABLE":
            head_fields = fields(next(records, b""))
            shift = 32 - head_fields.get(2, [0])[0]
            for m in map(fields, records):
                id_ = m[1][0] & 0xFFFFFFFF
                yield (id_ & ((1 << shift) - 1), m[2][0].decode("utf-8", "replace"), id_ >> shift if shift < 32 else None)
        elif self.section == "INODE_REFERENCE":
            for k, m in enumerate(map(fields, records)):
                yield k, m[1][0]
        elif self.section == "INODE_DIR":
            for m in map(fields, records):
                yield m[1][0], numbers(m.get(2, [])), numbers(m.get(3, []))
        else:
            if head:
                next(records, None)
            yield from map(_inode if self.section == "INODE" else _id, records)


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dirgauge_image"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("section", "INODE").upper()]

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options["path"], self.options.get("section", "INODE").upper())


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """inodes, edges (with reference children resolved), strings of an image."""
    spark.dataSource.register(ImageSource)
    part = lambda s: spark.read.format("dirgauge_image").option("section", s).load(path)
    dirs = part("INODE_DIR")
    plain = dirs.select("parent_id", F.posexplode("children").alias("pos", "child_id"), F.lit(False).alias("is_ref"))
    _, sections = summary(path)
    edges = plain.select("parent_id", "child_id", "pos", "is_ref")
    if "INODE_REFERENCE" in sections:
        refs = dirs.select("parent_id", F.size("children").alias("n"), F.posexplode("ref_children").alias("k", "ref_idx")).join(part("INODE_REFERENCE"), "ref_idx")
        edges = edges.unionByName(refs.select("parent_id", F.col("inode_id").alias("child_id"), (F.col("n") + F.col("k")).alias("pos"), F.lit(True).alias("is_ref")))
    return {"inodes": part("INODE"), "edges": edges, "strings": part("STRING_TABLE")}


def _in_space(strings: DataFrame, space) -> DataFrame:
    """Entries of one kind of name: those of its space, or all in tables where all kinds share one (space is null)."""
    return strings.where(F.col("space").isNull() | (F.col("space") == space))


def named(inodes: DataFrame, strings: DataFrame) -> DataFrame:
    """inodes with owner, grp and mode from their packed permission, and names instead of numbers in acl; unknown numbers give null.

    Newer images number users and groups apart: high bits of a string's number tell its space.
    """
    out = inodes.withColumns({k: c for k, c in unpack_permission(F.col("permission")).items()})
    for number, name in (("user_id", "owner"), ("group_id", "grp")):
        own = _in_space(strings, SPACES["USER" if name == "owner" else "GROUP"])
        out = out.join(own.select(F.col("id").alias(number), F.col("str").alias(name)), number, "left").drop(number)
    entries = inodes.where(F.size("acl") > 0).select("id", F.posexplode("acl").alias("pos", "e"))
    names = strings.select(F.col("id").alias("_name"), "str", "space")
    space = F.when(F.col("e.type") == "USER", SPACES["USER"]).when(F.col("e.type") == "GROUP", SPACES["GROUP"]).otherwise(0)
    entries = entries.join(names, (F.col("e.name_id") == F.col("_name")) & (F.col("space").isNull() | (F.col("space") == space)), "left")
    entry = F.struct("e.scope", "e.type", F.col("str").alias("name"), "e.perm")
    lists = entries.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("acl")).select("id", F.col("acl.entry").alias("acl"))
    return out.drop("acl").join(lists, "id", "left")


def sized(inodes: DataFrame) -> DataFrame:
    """inodes with size, consumed and n_blocks; 0 for other nodes than files."""
    blocks = F.coalesce("blocks", F.array().cast(inodes.schema["blocks"].dataType))
    return inodes.withColumns({"size": file_size(blocks), "consumed": consumed_size(blocks, F.col("replication"), F.col("ec_policy_id")), "n_blocks": F.size(blocks).cast("long")})


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of an image as reports take them, written once for each state of the file in an application.

    A node that is a reference child as well has a row for each parent. All columns of
    inodes are there; acl has names.
    """

    def derive() -> DataFrame:
        image = load(spark, path)
        inodes = store.table(image["inodes"])
        parents = image["edges"].select(F.col("child_id").alias("id"), "parent_id", "pos", "is_ref")
        rows = sized(named(inodes, image["strings"])).join(parents, "id", "left")
        return place(rows.withColumn("parent_id", F.coalesce("parent_id", F.lit(0))), ROOT)

    return store.once(spark, ("image", path, store.state(spark, [path])), derive)
