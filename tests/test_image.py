import io

import image_writer as w
import pytest
from pyspark.sql import functions as F

from dirgauge.operators.lookups import Namespace
from dirgauge.render import text
from dirgauge.sources import image, synthetic


def perm(user, group, mode):
    return user << 40 | group << 16 | mode


@pytest.mark.parametrize("codec", ["", *(f"org.apache.hadoop.io.compress.{c}" for c in ("DefaultCodec", "GzipCodec", "ZStandardCodec"))])
def test_round_trip(spark, tmp_path, codec, monkeypatch):
    inodes = [w.inode(2, 16385, "", w.dir_body(perm(1, 2, 0o755), (1 << 63) - 1)), w.inode(2, 16386, "a", w.dir_body(perm(1, 2, 0o755))), w.inode(1, 16387, "é", w.file_body(perm(5, 4, 0o644), [(1, 2, 30), (3, 4, 50)], 3, acl=(5 << 8 | 1 << 3 | 6,))), w.inode(3, 16388, "l", w.link_body(perm(1, 2, 0o777), "/a"))]
    sections = {
        "STRING_TABLE": w.rec(w.num(1, 2)) + w.rec(w.num(1, 1) + w.raw(2, b"mm")) + w.rec(w.num(1, 5) + w.raw(2, b"foo")),
        "INODE": w.rec(w.num(1, 16388) + w.num(2, 4)) + b"".join(inodes),
        "INODE_REFERENCE": w.rec(w.num(1, 16387)),
        "INODE_DIR": w.rec(w.num(1, 16385) + w.raw(2, w.var(16386) + w.var(16388))) + w.rec(w.num(1, 16386) + w.raw(2, w.var(16387))) + w.rec(w.num(1, 16385) + w.raw(3, w.var(0))),
    }
    w.write(path := tmp_path / "image", sections, codec)
    monkeypatch.setattr(image, "PART_BYTES", 60)
    monkeypatch.setattr(image, "PIECE", 7)
    got = image.load(spark, str(path))
    rows = {r.id: r for r in got["inodes"].collect()}
    assert len(rows) == 4 and rows[16387].name == "é" and [b.num_bytes for b in rows[16387].blocks] == [30, 50] and rows[16387].permission == perm(5, 4, 0o644)
    assert rows[16385].ns_quota == (1 << 63) - 1 and rows[16386].ns_quota == -1 and rows[16388].target == "/a"
    assert tuple(rows[16387].acl[0]) == ("ACCESS", "GROUP", 5, 6)
    assert {(r.parent_id, r.child_id, r.is_ref) for r in got["edges"].collect()} == {(16385, 16386, False), (16385, 16388, False), (16386, 16387, False), (16385, 16387, True)}
    assert {r.id: r.str for r in got["strings"].collect()} == {1: "mm", 5: "foo"}
    reader = image.ImageReader(str(path), "INODE")
    assert sum(p.length for p in reader.partitions()) == reader.length


def test_names_in_spaces_of_their_own(spark, tmp_path):
    space = {"global": 0, "user": 1 << 30, "group": 2 << 30}
    strings = [(space["user"] | 1, "ann"), (space["group"] | 1, "staff"), (space["user"] | 2, "bob"), (space["group"] | 2, "ops"), (7, "plain")]
    acl = (2 << 8 | 0 << 3 | 6, 2 << 8 | 1 << 3 | 4, 7 << 8 | 3 << 3 | 4)
    w.write(path := tmp_path / "image", {
        "STRING_TABLE": w.rec(w.num(1, len(strings)) + w.num(2, 2)) + b"".join(w.rec(w.num(1, k) + w.raw(2, v.encode())) for k, v in strings),
        "INODE": w.rec(w.num(1, 16386) + w.num(2, 2)) + w.inode(2, 16385, "", w.dir_body(1 << 40 | 1 << 16 | 0o755)) + w.inode(1, 16386, "f", w.file_body(2 << 40 | 2 << 16 | 0o644, [], acl=acl)),
        "INODE_DIR": w.rec(w.num(1, 16385) + w.raw(2, w.var(16386))),
    })
    rows = {r.path: r for r in image.nodes(spark, str(path)).collect()}
    assert (rows["/"].owner, rows["/"].grp, rows["/f"].owner, rows["/f"].grp) == ("ann", "staff", "bob", "ops")
    assert [e.name for e in rows["/f"].acl] == ["bob", "ops", "plain"]


def test_nodes_with_references_and_entries(spark, tmp_path):
    strings = {1: "mm", 2: "gg", 5: "acluser"}
    inodes = [
        w.inode(2, 16385, "", w.dir_body(1 << 40 | 2 << 16 | 0o755)), w.inode(2, 16386, "a", w.dir_body(1 << 40 | 2 << 16 | 0o1755, acl=(5 << 8 | 1 << 5 | 7,))),
        w.inode(1, 16387, "f", w.file_body(5 << 40 | 9 << 16 | 0o644, [(1, 2, 10 << 20), (3, 4, 0)], 3, ec=1, acl=(5 << 8 | 6, 0 << 8 | 3 << 3 | 4))), w.inode(3, 16388, "l", w.link_body(1 << 40 | 2 << 16 | 0o777, "/a")), w.inode(2, 16389, "lost", w.dir_body(1)),
    ]
    w.write(path := tmp_path / "image", {
        "STRING_TABLE": w.rec(w.num(1, 3)) + b"".join(w.rec(w.num(1, k) + w.raw(2, v.encode())) for k, v in strings.items()),
        "INODE": w.rec(w.num(1, 16389) + w.num(2, 5)) + b"".join(inodes), "INODE_REFERENCE": w.rec(w.num(1, 16387)),
        "INODE_DIR": w.rec(w.num(1, 16385) + w.raw(2, w.var(16386) + w.var(16388)) + w.raw(3, w.var(0))) + w.rec(w.num(1, 16386) + w.raw(2, w.var(16387))),
    })
    nodes = image.nodes(spark, str(path))
    rows = {r.path: r for r in nodes.collect()}
    assert sorted(rows) == ["/", "/a", "/a/f", "/f", "/l"] and rows["/f"].is_ref and not rows["/a/f"].is_ref
    assert (rows["/f"].owner, rows["/f"].grp, rows["/f"]["mode"], rows["/f"]["size"], rows["/f"].consumed, rows["/f"].n_blocks, rows["/f"].effective_replication) == ("acluser", None, 0o644, 10 << 20, 16 << 20, 2, 1)
    space = Namespace(nodes, image.load(spark, str(path))["edges"])
    assert space.child_ids(16385) == [16386, 16388, 16387] and space.child_ids(16388) == [] and space.n_children(16386) == 1
    assert space.has_children("/a") and not space.has_children(16388) and space.permission("/a") == "mm:gg:1755"
    assert space.acl_status("/a")["sticky"] and [tuple(e) for e in space.acl_status("/a")["entries"]] == [("DEFAULT", "USER", "acluser", 7)]
    assert space.permission("/f") == "acluser::0644"
    for write, more in ((text.paths_text, {}), (text.small_files_text, {"limit": 1 << 40})):
        write(nodes, ["/"], out := io.StringIO(), **more)
        assert "/a" in out.getvalue()
    text.summary_text(nodes, "/", out := io.StringIO())
    assert "By group:            2 |" in out.getvalue()
    assert [tuple(e) for e in space.acl_entries("/a/f")] == [("ACCESS", "USER", "acluser", 6), ("ACCESS", "OTHER", None, 4)] and space.acl_entries("/l") == []


def test_bad_images(tmp_path):
    (tmp_path / "x").write_bytes(b"NOTANIMAGE....")
    with pytest.raises(ValueError, match="not a checkpoint image"):
        image.summary(str(tmp_path / "x"))
    w.write(path := tmp_path / "y", {"INODE": b""}, "org.apache.hadoop.io.compress.SnappyCodec")
    with pytest.raises(ValueError, match="No section"):
        image.ImageReader(str(path), "INODE_DIR")
    with pytest.raises(ValueError, match="Section INODE of .* Codec .* isn't supported"):
        list(image.ImageReader(str(path), "INODE").read(image.Part(0, 8, True)))
    with pytest.raises(ValueError, match="cut off"):
        list(image.delimited(iter([w.rec(b"abc"), b"\x05ab"])))


def test_parts_of_a_large_section(tmp_path, monkeypatch):
    body = w.rec(w.num(1, 9) + w.num(2, 700)) + b"".join(w.inode(1 + k % 3, 20000 + k, f"n{k}" * (k % 40), w.dir_body(k) if k % 3 == 1 else w.link_body(k, "/t" * (k % 9)) if k % 3 == 2 else w.file_body(k, [(j, j, j) for j in range(k % 90)])) for k in range(700))
    w.write(path := tmp_path / "large", {"INODE": body})
    monkeypatch.setattr(image, "PART_BYTES", 9000)
    monkeypatch.setattr(image, "PIECE", 512)
    reader = image.ImageReader(str(path), "INODE")
    parts = reader.partitions()
    assert len(parts) > 10 and sum(p.length for p in parts) == reader.length
    assert [r[0] for p in parts for r in reader.read(p)] == [*range(20000, 20700)]
    only = image.ImageReader(str(path), "INODE_ID")
    assert [r[0] for p in only.partitions() for r in only.read(p)] == [*range(20000, 20700)]
    with pytest.raises(ValueError, match="cut off"):
        list(reader.read(image.Part(parts[0].offset, parts[0].length - 3, True)))


def test_synthetic(spark):
    counts = {r.type: r.n for r in synthetic.inodes(spark).groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"DIRECTORY": 807, "FILE": 209560}
    small = synthetic.nodes(spark, depth=3, width=2, per_dir=2)
    paths = [r.path for r in small.select("path").collect()]
    want = {"/"} | {f"/{chr(97 + a)}{b}" for a in range(26) for b in ["", "/a", "/b", "/a/a", "/a/b", "/b/a", "/b/b"]}
    want |= {f"{d}/file_{k}" for d in want - {"/"} for k in range(2)}
    assert len(paths) == len(want) and set(paths) == want and synthetic.edges(spark, 3, 2, 2).count() == len(want) - 1
