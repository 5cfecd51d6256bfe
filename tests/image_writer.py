"""Writes small images for tests."""

import gzip
import struct
import zlib


def var(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def num(field, n):
    return var(field << 3) + var(n)


def raw(field, data):
    return var(field << 3 | 2) + var(len(data)) + data


def fixed(field, n):
    return var(field << 3 | 1) + struct.pack("<Q", n)


def rec(data):
    return var(len(data)) + data


def inode(kind, id_, name, body):
    return rec(num(1, kind) + num(2, id_) + raw(3, name.encode()) + raw(3 + kind, body))


def file_body(perm, blocks, rep=1, ec=None, policy=None, acl=(), mtime=1000, atime=900):
    out = num(1, rep) + num(2, mtime) + num(3, atime) + num(4, 134217728) + fixed(5, perm)
    out += b"".join(raw(6, num(1, b) + num(2, g) + num(3, n)) for b, g, n in blocks)
    if acl:
        out += raw(8, raw(1, struct.pack(f"<{len(acl)}I", *acl)))
    return out + (num(10, policy) if policy is not None else b"") + (num(12, ec) if ec else b"")


def dir_body(perm, ns=-1, ds=-1, mtime=1000, acl=()):
    return num(1, mtime) + num(2, ns) + num(3, ds) + fixed(4, perm) + (raw(5, raw(1, struct.pack(f"<{len(acl)}I", *acl))) if acl else b"")


def link_body(perm, target):
    return fixed(1, perm) + raw(2, target.encode()) + num(3, 7) + num(4, 8)


def packed(body, codec):
    if codec.endswith("GzipCodec"):
        return gzip.compress(body)
    if codec.endswith("ZStandardCodec"):
        import zstandard

        return zstandard.compress(body)
    return zlib.compress(body) if codec else body


def write(path, sections, codec=""):
    data, index = b"HDFSIMG1", b""
    for name, body in sections.items():
        body = packed(body, codec)
        index += raw(4, raw(1, name.encode()) + num(2, len(body)) + num(3, len(data)))
        data += body
    top = num(1, 1) + num(2, 1) + (raw(3, codec.encode()) if codec else b"") + index
    top = rec(top)
    path.write_bytes(data + top + struct.pack(">I", len(top)))


STRINGS = {"mm": 1, "supergroup": 2, "root": 3, "nobody": 4, "foo": 5}
#: path, user, group, bytes of blocks.
FILES = [
    ("/test3/foo/bar/test_20MiB.img", "mm", "nobody", [20971520]), ("/test3/foo/bar/test_2MiB.img", "mm", "supergroup", [2097152]), ("/test3/foo/bar/test_40MiB.img", "mm", "supergroup", [41943040]),
    ("/test3/foo/bar/test_4MiB.img", "mm", "supergroup", [4145152]), ("/test3/foo/bar/test_5MiB.img", "mm", "supergroup", [5181440]), ("/test3/foo/bar/test_80MiB.img", "mm", "supergroup", [83886080]),
    ("/test3/foo/test_1KiB.img", "root", "root", [1024]), ("/test3/foo/test_20MiB.img", "mm", "supergroup", [20971520]), ("/test3/test.img", "mm", "supergroup", [1048576]),
    ("/test3/test_160MiB.img", "foo", "nobody", [134217728, 33554432]), ("/test_2KiB.img", "mm", "supergroup", [2048]),
]
DIRS = {"/": 16385, "/test1": 16386, "/test2": 16387, "/test3": 16388, "/test3/foo": 16389, "/test3/foo/bar": 16390, "/user": 16391, "/user/mm": 16392}
MTIMES = {"/": 1499493618390, "/test2": 1497733426149, "/test3": 1497734744891}


def perm(user, group, mode):
    return STRINGS[user] << 40 | STRINGS[group] << 16 | mode


def write_small(path, codec=""):
    """The small namespace of FIXTURES.md: 8 directories and 11 files of 348,019,712 bytes."""
    ids = dict(DIRS)
    nodes = [inode(2, id_, p.rsplit("/", 1)[1], dir_body(perm("mm", "supergroup", 0o755), (1 << 63) - 1 if p == "/" else -1, -1, MTIMES.get(p, 1000))) for p, id_ in DIRS.items()]
    for k, (p, user, group, sizes) in enumerate(FILES):
        ids[p] = 16402 if "160" in p else 16393 + k
        times = {"mtime": 1497734744886, "atime": 1497734743534} if "160" in p else {}
        first = 1073741834 if "160" in p else 1000 + 10 * k
        nodes.append(inode(1, ids[p], p.rsplit("/", 1)[1], file_body(perm(user, group, 0o644), [(first + j, (1010 if "160" in p else 1) + j, n) for j, n in enumerate(sizes)], policy=0, **times)))
    below = {}
    for p, id_ in sorted(ids.items()):
        if p != "/":
            below.setdefault(p.rsplit("/", 1)[0] or "/", []).append(id_)
    write(path, {
        "STRING_TABLE": rec(num(1, len(STRINGS))) + b"".join(rec(num(1, k) + raw(2, name.encode())) for name, k in STRINGS.items()),
        "INODE": rec(num(1, max(ids.values())) + num(2, len(nodes))) + b"".join(nodes),
        "INODE_DIR": b"".join(rec(num(1, ids[p]) + raw(2, b"".join(map(var, kids)))) for p, kids in below.items()),
    }, codec)
    return str(path)
