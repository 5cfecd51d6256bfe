"""Scalar functions on namespace columns, as Spark column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Erasure-coding policies, fixed values: id -> (data units, parity units); every cell has CELL bytes.
EC_POLICIES = {1: (6, 3), 2: (3, 2), 3: (6, 3), 4: (2, 1), 5: (10, 4)}
CELL = 1048576
#: Storage policies, fixed values: id -> name. Unset and 0 mean the default.
STORAGE_POLICIES = {1: "PROVIDED", 2: "COLD", 5: "WARM", 7: "HOT", 10: "ONE_SSD", 12: "ALL_SSD", 15: "LAZY_PERSIST"}
DEFAULT_POLICY = 7
MIB = 1048576
UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
INITIAL_BUCKETS = 18


def unpack_permission(p: Column) -> dict[str, Column]:
    """user id, group id and mode of a packed permission."""
    return {"user_id": F.shiftright(p, 40).bitwiseAND(0xFFFFFF), "group_id": F.shiftright(p, 16).bitwiseAND(0xFFFFFF), "mode": p.bitwiseAND(0xFFFF).cast("int")}


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 4, "0")


def permission_text(user: Column, group: Column, mode: Column) -> Column:
    return F.concat_ws(":", user, group, octal_mode(mode))


def symbolic_mode(mode: Column) -> Column:
    """rwxr-xr-x; with the sticky bit the last character is t, or T without execute."""
    bits = [F.when(mode.bitwiseAND(1 << (8 - k)) != 0, "rwx"[k % 3]).otherwise("-") for k in range(8)]
    run = mode.bitwiseAND(1) != 0
    last = F.when(mode.bitwiseAND(0o1000) != 0, F.when(run, "t").otherwise("T")).otherwise(F.when(run, "x").otherwise("-"))
    return F.concat(*bits, last)


def normalize_path(path: Column) -> Column:
    """One slash for several, none at the end but for the root."""
    return F.regexp_replace(F.regexp_replace(path, "//+", "/"), r"(?s)(.)/\z", "$1")


def child_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(parent, F.lit("/"), name))


def ancestors_or_self(path: Column) -> Column:
    """Every directory from / to path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    deeper = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.when(F.size(parts) == 0, F.array(F.lit("/"))).otherwise(F.concat(F.array(F.lit("/")), deeper))


def file_replication(replication: Column, ec: Column) -> Column:
    """1 for erasure-coded files, else what is stored."""
    return F.when(ec.isNotNull(), F.lit(1)).otherwise(replication)


def file_size(blocks: Column) -> Column:
    """Sum of the blocks' bytes; 0 without blocks."""
    return F.coalesce(F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + b["num_bytes"]), F.lit(0).cast("long"))


def _unit(policy: Column, which: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in EC_POLICIES.items() for x in (k, v[which])]), policy)


def block_parity(num_bytes: Column, ec: Column) -> Column:
    """Bytes of one block's parity cells; 0 without erasure coding."""
    stripes = F.ceil(F.ceil(num_bytes / CELL) / _unit(ec, 0))
    return F.when(ec.isNull(), F.lit(0)).otherwise(stripes * _unit(ec, 1) * CELL).cast("long")


def block_consumed(num_bytes: Column, replication: Column, ec: Column) -> Column:
    """Bytes that one block takes on disk: with its parity cells, or times the replication."""
    return F.when(ec.isNull(), num_bytes * replication).otherwise(num_bytes + block_parity(num_bytes, ec)).cast("long")


def consumed_size(blocks: Column, replication: Column, ec: Column) -> Column:
    return F.coalesce(F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + block_consumed(b["num_bytes"], replication, ec)), F.lit(0).cast("long"))


def storage_policy(policy: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STORAGE_POLICIES.items() for x in pair])
    return F.element_at(names, F.when(policy.isNull() | (policy == 0), DEFAULT_POLICY).otherwise(policy))


def size_bucket(size: Column) -> Column:
    """0: empty; 1: below 1 MiB; 2: below 2 MiB; then one more for each doubling."""
    return F.when(size == 0, 0).when(size < MIB, 1).when(size < 2 * MIB, 2).otherwise(F.floor(F.ln(size / (2 * MIB)) / F.ln(F.lit(2.0)) + 1e-12).cast("int") + 3).cast("int")


@dataclass(frozen=True)
class BucketModel:
    """How a histogram cuts sizes: the bucket of a size (0 for empty files), and a bucket's exclusive upper border."""

    bucket: Callable[[Column], Column]
    border: Callable[[Column], Column]


def powers(base: int, first: int) -> BucketModel:
    """Buckets that end at first, first * base, first * base^2, ...; empty files have a bucket of their own."""
    log = lambda size: F.floor(F.ln(size / F.lit(float(first))) / F.ln(F.lit(float(base))) + 1e-12)
    return BucketModel(
        lambda size: F.when(size == 0, 0).when(size < first, 1).otherwise(log(size) + 2).cast("int"),
        lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise((F.lit(first) * F.pow(F.lit(float(base)), k - 1)).cast("long")),
    )


def bucket_border(bucket: Column) -> Column:
    """Exclusive upper bound of a bucket, 0 for the empty files'."""
    return F.when(bucket == 0, F.lit(0).cast("long")).otherwise(F.lit(MIB).cast("long") * F.pow(F.lit(2.0), bucket - 1).cast("long"))


def iec_format(size: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1, rounded half up."""
    unit = F.least(F.floor(F.ln(size.cast("double")) / F.ln(F.lit(1024.0)) + 1e-12), F.lit(6)).cast("int")
    names = F.array(*map(F.lit, UNITS))
    rounded = F.floor(size / F.pow(F.lit(1024.0), unit) + 0.5).cast("long").cast("string")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(rounded, F.lit(" "), F.element_at(names, unit + 1)))


def iec_parse(text: Column) -> Column:
    """Bytes of a number with an optional unit, whatever its case; unknown units count as bytes; null if there is no number."""
    pattern = r"\A(\d+)\s*(\w*)\z"
    factor = F.lit(1).cast("long")
    for k, unit in enumerate(UNITS[1:6], 1):
        factor = F.when(F.upper(F.regexp_extract(text, pattern, 2)) == unit.upper(), F.lit(1024**k)).otherwise(factor)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("long") * factor)


def size_labels(sizes: Column) -> Column:
    """IEC labels of an array of sizes."""
    return F.transform(sizes, iec_format)


def text_lengths(texts: Column) -> Column:
    return F.transform(texts, F.length)


def elementwise_max(a: Column, b: Column) -> Column:
    """The larger of two arrays at each place; where one has ended, the other's."""
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def digit_count(n: Column) -> Column:
    return F.length(n.cast("string"))


def mebibytes(size: Column) -> Column:
    return F.floor(size / MIB).cast("long")


def type_char(kind: Column) -> Column:
    return F.when(kind == "FILE", "-").when(kind == "DIRECTORY", "d").otherwise("l")


def type_letter(kind: Column) -> Column:
    """As in JSON: f, d or l."""
    return F.when(kind == "FILE", "f").when(kind == "DIRECTORY", "d").otherwise("l")


def unsigned(n: Column) -> Column:
    """A signed 64-bit number read as an unsigned one."""
    return F.when(n < 0, n.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(n.cast("decimal(20,0)"))


def padded(values: Column, n: int) -> Column:
    """The first n of values, with zeros where there are fewer."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0).cast("long"), n)), 1, n)


def parse_size(text: str) -> int:
    """Bytes of a text such as 3MiB or 2048, as iec_parse(); ValueError where there is no number."""
    found = re.fullmatch(r"(\d+)\s*(\w*)", text.strip(), re.ASCII)
    if not found:
        raise ValueError(f"A size is a number with an optional unit such as MiB, not {text!r}")
    units = [u.upper() for u in UNITS[:6]]
    return int(found[1]) * (1024 ** units.index(found[2].upper()) if found[2].upper() in units else 1)


def format_size(n: int) -> str:
    """As iec_format(), for one number."""
    unit = 0
    while unit < 6 and n >= 1024 ** (unit + 1):
        unit += 1
    return f"{(2 * n + 1024**unit) // (2 * 1024**unit)} {UNITS[unit]}"


def parse_age(text: str) -> int:
    """Milliseconds of an age such as 3y, 30d or 12h; an empty text is 0."""
    if not text:
        return 0
    found = re.fullmatch(r"(\d+)([yYdDhH])", text)
    if not found:
        raise ValueError(f"An age is a number with y, d or h, not {text!r}")
    return int(found[1]) * {"y": 365 * 24, "d": 24, "h": 1}[found[2].lower()] * 3_600_000
