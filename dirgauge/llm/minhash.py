"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification.

A document is the set of its distinct shingles of a few words. Two permutations make all
coordinates of its signature: the first shuffles the shingles' positions, the second is
shifted circularly by one more for each coordinate, and the coordinate is the smallest
value met. Equal sets are joined by a hash of the whole set before anything else. Bands of
signature coordinates put sets into buckets. In each bucket every set is compared to one
hub, by turns the member that meets most others over all its buckets or any member; links
found join into components. What a star can miss are links between members of different components of
one bucket: members outside a bucket's largest component are compared with its others in
blocks, by signature first, and only links leave a block. Every link is confirmed on the full sets, whose intersection is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirgauge.llm.common import read, table
from dirgauge.llm.components import connected_components
from dirgauge.llm.textkeys import lists, mix, shingles, signed, text_words

ROWS, BANDS = 5, 25
#: Standard deviations that a link's signatures may fall below the bound before a pair is dropped unseen.
DEVIATIONS = 6.0
#: Members of a bucket that are compared with each other at once.
BLOCK = 128
#: Sets compared to one hub by one task.
HUB_ROWS = 2000


def _permute(x: np.ndarray) -> None:
    """A permutation of the 32-bit ring, in place."""
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)


def signature(items: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of distinct 64-bit items: coordinate k is the least of p2(p1(item) + k)."""
    start = (mix(items) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, size + 1, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, 120_000 // size)
    for k in range(0, len(start), step):
        x = np.add.outer(start[k : k + step], shifts)
        _permute(x)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def _whole(items: np.ndarray) -> str:
    """A hash of a whole set of distinct items."""
    mixed = mix(items + np.uint64(len(items)))
    return f"{int(mixed.sum()):016x}{int(np.bitwise_xor.reduce(mix(mixed))):016x}"


def _sign(words: int, rows: int, bands: int):
    weights = mix(np.arange(1, rows + 1, dtype=np.uint64))
    names = mix(np.arange(101, 101 + bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, whole, keys = [], [], [], []
            for h in text_words(batch.column(1), fold=True):
                items = np.unique(shingles(h, words))
                sizes.append(len(items))
                if len(items):
                    s = signature(items, rows * bands)
                    marks.append(s.tobytes())
                    whole.append(_whole(items))
                    grouped = s.reshape(bands, rows).astype(np.uint64)
                    keys.append(signed(mix((grouped * weights).sum(axis=1, dtype=np.uint64) ^ names)))
                else:
                    marks.append(None)
                    whole.append(None)
                    keys.append(np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(whole, pa.string()), pa.array(marks, pa.binary()), lists(keys, pa.int64())], names=["doc", "row_key", "n_shingles", "whole", "mark", "bands"])

    return run


def _sets(words: int):
    """The sets of texts whose whole set is the one that is meant (rows that repeat an id with another text have others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meant, items, keep = batch.column(2).to_pylist(), [], []
            for k, h in enumerate(text_words(batch.column(1), fold=True)):
                own = np.unique(shingles(h, words))
                if len(own) and _whole(own) == meant[k]:
                    items.append(signed(own))
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), lists(items, pa.int64())], names=["rep", "items"])

    return run


def _floor(percent: int, size: int, deviations: float | None) -> float:
    """Share of equal coordinates that a link's signatures fall below only by so many standard deviations; 0 for None."""
    return 0.0 if deviations is None else percent / 100 - deviations * (percent / 100 * (1 - percent / 100) / size) ** 0.5


def _block(key, data: pa.Table, size: int, deviations: float | None):
    """The component of each member of a block, and candidates(percent): for each member of side 0, those of side 1 it may link with.

    Candidates are of other components, of fitting size, share this bucket first with the
    member, and have signatures that don't agree far too little (so many standard deviations
    below the bound); they come most alike first.
    """
    comp, side, n = (data.column(k).to_numpy() for k in ("component", "side", "n_shingles"))
    mark = np.frombuffer(b"".join(data.column("mark").to_pylist()), dtype=np.uint32).reshape(len(comp), size)
    band = np.array(data.column("bands").to_pylist(), dtype=np.int64)
    here = int(np.flatnonzero((band == key[0].as_py()).any(axis=0))[0])
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def candidates(percent: int) -> Iterator[tuple[int, np.ndarray]]:
        for i in a:
            others = b[(comp[b] != comp[i]) & (100 * np.minimum(n[b], n[i]) >= percent * np.maximum(n[b], n[i]))]
            others = others[(band[others] == band[i]).argmax(axis=1) == here]
            same = (mark[others] == mark[i]).mean(axis=1)
            order = np.argsort(-same, kind="stable")
            yield i, others[order[same[order] >= _floor(percent, size, deviations)]]

    return comp, candidates


def _cross_members(rows: int, bands: int, percent: int, deviations: float | None):
    """The members of a block that have a candidate or are one, by signatures alone."""

    def run(key, data):
        data = data.combine_chunks()
        asked = np.zeros(len(data), dtype=bool)
        for i, others in _block(key, data, rows * bands, deviations)[1](percent):
            asked[others] = True
            asked[i] |= len(others) > 0
        return data.select(["bucket", "i", "j", "side", "rep", "component"]).filter(pa.array(asked))

    return run


def _cross_links(rows: int, bands: int, percent: int, deviations: float | None):
    """Links between sides 0 and 1 of different components, on full sets: one for each member of side 0 and component."""

    def run(key, data):
        data = data.combine_chunks()
        comp, candidates = _block(key, data, rows * bands, deviations)
        rep, listed = data.column("rep").to_numpy(), data.column("items").chunk(0)
        offsets, values = listed.offsets.to_numpy(), listed.values.to_numpy()
        n = np.diff(offsets)
        left, right = [], []
        for i, others in candidates(percent):
            joined = set()
            for j in others:
                if comp[j] in joined:
                    continue
                met = len(np.intersect1d(values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]], assume_unique=True))
                if 100 * met >= percent * (n[i] + n[j] - met):
                    joined.add(comp[j])
                    left.append(rep[i])
                    right.append(rep[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _agreeing(percent: int, deviations: float | None):
    """Pairs whose signatures don't agree far too little (so many standard deviations below the bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for k in ("mm", "mh"))
            keep = (a == b).mean(axis=1) >= _floor(percent, a.shape[1], deviations)
            yield batch.select(["member", "hub", "nm", "nh"]).filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, sizes: DataFrame, items: DataFrame, percent: int, deviations: float | None) -> DataFrame:
    """pairs(member, hub) whose sets meet percent / 100 in Jaccard similarity, exactly; hubs with many members are salted.

    Sets are sent only for pairs whose sizes and signatures leave a link possible.
    """
    n = sizes.select("rep", "n_shingles", "mark")
    sized = pairs.join(n.withColumnsRenamed({"rep": "member", "n_shingles": "nm", "mark": "mm"}), "member").join(n.withColumnsRenamed({"rep": "hub", "n_shingles": "nh", "mark": "mh"}), "hub")
    # |A & B| <= min and |A | B| >= max, so a link needs 100 min >= percent max
    sized = sized.where(100 * F.least("nm", "nh") >= percent * F.greatest("nm", "nh")).select("member", "hub", "nm", "nh", "mm", "mh")
    sized = table(sized.mapInArrow(_agreeing(percent, deviations), "member long, hub long, nm long, nh long"))
    parts = sized.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("parts"))
    hubs = items.withColumnRenamed("rep", "hub").join(parts, "hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hubs = hubs.select("hub", "part", F.col("items").alias("hub_items"))
    members = sized.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).drop("parts")
    members = members.join(items.withColumnsRenamed({"rep": "member", "items": "member_items"}), "member")
    both = members.join(hubs, ["hub", "part"])
    met = F.size(F.array_intersect("member_items", "hub_items")).cast("long")
    return both.where(100 * met >= percent * (F.col("nm") + F.col("nh") - met)).select("member", "hub")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, deviations: float | None = DEVIATIONS, detail: bool = False) -> DataFrame:
    """(doc, n_shingles, component_id, kept), one row per row of docs.

    Words are runs of other characters than ASCII white space, A-Z folded. Documents link
    at a Jaccard similarity of percent / 100 or more; component_id is the smallest id in
    reach, itself included. Null and wordless texts have empty sets and link with nothing.
    A text of fewer than words words has its whole sequence as its only shingle. Rows that
    repeat an id keep a row each and are linked by their own texts only; rows with a null id
    link with nothing, their component is null and they are kept. Other columns are ignored;
    an empty table gives no rows. detail adds row_key, a hash of id and text as row_key()
    gives it, and group, which names the component of the row's own text (null for an empty
    set or a null id).

    Pairs at the bound are missed with a probability of (1 - s^rows)^bands, below 1e-6 at
    0.85 with 5 rows in 25 bands (below 1e-4 at 0.8). Pairs whose signatures agree in fewer
    coordinates than deviations standard deviations below percent are dropped before their
    sets are met: for independent coordinates Chernoff's bound gives a link less than 1e-6
    to be among them with six deviations of 125 coordinates (circulant ones vary less).
    None drops no pair.
    """
    narrow = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), row_key(doc, text).alias("row_key"))
    signs = table(narrow.mapInArrow(_sign(words, rows, bands), "doc long, row_key long, n_shingles long, whole string, mark binary, bands array<long>"))
    known = signs.where("whole is not null and doc is not null")
    unique = _unique(signs)
    # where ids repeat, two sets may have the same smallest id: then numbers name them
    name = F.col("r.doc") if unique else F.monotonically_increasing_id()
    reps = table(known.groupBy("whole").agg(F.min(F.struct("doc", "n_shingles", "mark", "bands")).alias("r")).select("whole", name.alias("rep"), "r.doc", "r.n_shingles", "r.mark", "r.bands"))
    spread = reps.select("rep", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = table(spread.join(full, "bucket"))
    degree = met.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = met.join(degree, "rep")
    # half of the buckets take the member that meets most others, half any: groups that gather around one text, and groups without a centre
    rank = F.when(F.col("bucket") % 2 == 0, F.col("degree")).otherwise(F.xxhash64("rep", "bucket"))
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct(rank.alias("rank"), (-F.col("rep")).alias("least"))).alias("h")).select("bucket", (-F.col("h.least")).alias("hub"))
    stars = table(met.join(hubs, "bucket").where("rep <> hub").select(F.col("rep").alias("member"), "hub").distinct())
    asked = met.select("rep").distinct().join(reps.select("rep", "doc", "whole"), "rep")
    wanted = narrow.select("doc", "text").join(asked, "doc").select("rep", "text", "whole")
    items = wanted.mapInArrow(_sets(words), "rep long, items array<long>")
    items = table(items if unique else items.groupBy("rep").agg(F.min("items").alias("items")))
    links = table(_confirmed(stars, reps, items, percent, deviations))
    edges = links.select(F.col("member").alias("a"), F.col("hub").alias("b"))
    found = connected_components(edges)
    labelled = met.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all")).where("all > main.n")
    mixed = table(mixed.select("bucket", F.col("main.component").alias("main"), *[F.ceil(n / BLOCK).cast("int").alias(k) for k, n in (("asking", F.col("all") - F.col("main.n")), ("asked", F.col("all") / 4))]))
    if not mixed.isEmpty():
        edges = edges.union(table(_cross(labelled, mixed, reps, items, rows, bands, percent, deviations)))
        found = connected_components(edges)
    of_rep = reps.select("whole", "rep", "doc").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("whole", "doc", F.coalesce("component", "rep").alias("group"))
    if unique:
        of_rep = of_rep.select("whole", "group", F.col("group").alias("component"))
    else:
        of_rep = of_rep.select("whole", "group").join(of_rep.groupBy("group").agg(F.min("doc").alias("component")), "group")
    out = signs.select("doc", "row_key", "n_shingles", "whole").join(of_rep, "whole", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    more = ["row_key", F.when(F.col("doc").isNotNull(), F.col("group")).alias("group")] if detail else []
    return out.select(F.col("doc").alias(doc), "n_shingles", component.alias("component_id"), (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"), *more)


def row_key(doc: str, text: str) -> Column:
    return F.xxhash64(F.col(doc).cast("long"), F.col(text))


def _unique(signs: DataFrame) -> bool:
    return signs.where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty()


def _cross(labelled: DataFrame, mixed: DataFrame, reps: DataFrame, items: DataFrame, rows: int, bands: int, percent: int, deviations: float | None) -> DataFrame:
    """Links (a, b) of members outside their bucket's main component to members of other components, from blocks of either."""
    signed_reps = reps.select("rep", "n_shingles", "mark", "bands")
    members = labelled.join(mixed, "bucket").join(signed_reps, "rep")
    h, minor = F.xxhash64("rep"), F.col("component") != F.col("main")
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    asks = F.when(minor, F.transform(F.sequence(F.lit(0), F.col("asked") - 1), lambda j: cell(F.pmod(h, F.col("asking")), j, 0)))
    answers = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: cell(i, F.pmod(h, F.col("asked")), 1))
    sided = members.withColumn("cell", F.explode(F.concat(F.coalesce(asks, F.array().cast("array<struct<i:int,j:int,side:int>>")), answers))).select("bucket", "cell.*", "rep", "component", "n_shingles", "mark", "bands")
    found = table(sided.groupBy("bucket", "i", "j").applyInArrow(_cross_members(rows, bands, percent, deviations), "bucket long, i int, j int, side int, rep long, component long"))
    return found.join(signed_reps, "rep").join(items, "rep").groupBy("bucket", "i", "j").applyInArrow(_cross_links(rows, bands, percent, deviations), "a long, b long")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents, by three words, at 85 in 100."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM split),
runs AS (SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER follow, lead(x, 2) OVER follow) AS run FROM placed WINDOW follow AS (PARTITION BY doc_id ORDER BY i)),
items AS (SELECT DISTINCT doc_id, run FROM runs WHERE i <= greatest(1, n - 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY 1),
shared AS (SELECT doc_id, hash(run) AS run FROM items WHERE run IN (SELECT run FROM items GROUP BY run HAVING count(*) > 1)),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shared a JOIN shared b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met m JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m.n >= 85 * (x.n + y.n - m.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id
"""
