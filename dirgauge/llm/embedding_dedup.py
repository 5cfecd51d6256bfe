"""Embedding near-duplicates with an inverted multi-index.

Each half of the unit vectors has a codebook of its own, fitted on a bounded sample; a
vector's cell is its nearest centre in either half, a cell of the product grid. A vector
visits the grid's cells in the order of a multi-sequence traversal, by the sum of its
squared distances to the two centres, as far as the reach: the sum may exceed that of its
own cell by so much. The reach is measured in two ways, and the larger one counts: sampled
vectors get made-up partners at the threshold in random directions, the farthest that still
link, and the target share of them is found from either side, however few links the table
has; and sampled vectors are compared with all rows by brute force, and the target share of
their links lies in visited cells. Visited cells' vectors are then compared by cosine in
double precision.

Equal vectors are one class with a weight. Cells are cut into blocks, so that one with very
many vectors is the work of many tasks; a block gives counts and the edges of a spanning
forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from dirgauge.llm.common import read, table
from dirgauge.llm.components import connected_components

#: Vectors the codebooks are fitted on, and vectors whose links are searched by brute force, about.
FIT_ROWS, PROBE_ROWS = 8192, 256
TARGET_RECALL, LEAST_CELLS = 0.9995, 4
#: How finely the reach that links need is told.
STEP = 1e-3
#: Made-up partners of each probe.
PARTNERS = 32
CELL_ROWS, ASKING, ASKED = 64, 1024, 1024


def _unit(rows: pa.Array | pa.ChunkedArray | list) -> np.ndarray:
    """Unit vectors of rows, which are of one length and neither zero nor hold nulls."""
    if isinstance(rows, list):
        x = np.asarray(rows, dtype=np.float64)
    else:
        chunks = rows.chunks if isinstance(rows, pa.ChunkedArray) else [rows]
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).astype(np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _firsts(lists_: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, starts) of a list column: row k has values[starts[k]:starts[k + 1]]."""
    column = lists_.combine_chunks() if isinstance(lists_, pa.ChunkedArray) else lists_
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    starts = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    return column.flatten().to_numpy(zero_copy_only=False), starts


def _centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spaced rows of the sorted sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(x, c).argmin(axis=1)
        for j in range(k):
            if (own := near == j).any():
                c[j] = x[own].mean(axis=0)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None, :])


def traverse(d1: np.ndarray, d2: np.ndarray, reach: float, least: int = LEAST_CELLS) -> np.ndarray:
    """The cells i * len(d2) + j in order of d1[i] + d2[j] up to reach above the least sum (multi-sequence traversal, ties by cell); at least so many.

    Cells among the least n of all have (rank in d1 + 1) * (rank in d2 + 1) <= n, since all
    cells of no larger ranks come first; with that, and with a bound for each i on how far
    d2 may go, only few sums are looked at.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1] - d1[o1[0]], d2[o2] - d2[o2[0]]
    ends = np.maximum(np.searchsorted(s2, reach - s1, side="right"), np.minimum(least // (np.arange(len(s1)) + 1), len(s2)))
    ends = ends[: np.flatnonzero(ends)[-1] + 1]
    i = np.repeat(np.arange(len(ends)), ends)
    j = np.arange(len(i)) - np.repeat(np.cumsum(ends) - ends, ends)
    cells, sums = o1[i] * len(d2) + o2[j], s1[i] + s2[j]
    order = np.lexsort((cells, sums))
    return cells[order[: max(least, np.searchsorted(sums[order], reach, side="right"))]]


def _excess(queries: np.ndarray, ids: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float):
    """For each batch of all rows, how many links of the queries lie in cells so many STEPs (rounded up) above the query's least sum: (steps, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = queries.shape[1] // 2
        q1, q2 = (_squares(x, c) for x, c in zip((queries[:, :half], queries[:, half:]), books, strict=True))
        q1, q2 = q1 - q1.min(axis=1, keepdims=True), q2 - q2.min(axis=1, keepdims=True)
        for batch in batches:
            steps = np.zeros(0, np.int64)
            if batch.num_rows:
                x = _unit(batch.column(1))
                links = (queries @ x.T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                a, b = (_squares(y, c).argmin(axis=1) for y, c in zip((x[:, :half], x[:, half:]), books, strict=True))
                q, r = np.nonzero(links)
                steps = np.ceil((q1[q, a[r]] + q2[q, b[r]]) / STEP).astype(np.int64)
            at, n = np.unique(steps, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["steps", "n"])

    return run


def _partner_excess(queries: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """For PARTNERS vectors at the threshold from each query how far one's cell is above the other's least sum, on the side where that is less; ascending."""
    half, rng, out = queries.shape[1] // 2, np.random.default_rng(0), []
    for q in queries:
        away = rng.normal(size=(PARTNERS, len(q)))
        away -= (away @ q)[:, None] * q
        near = threshold * q + max(0.0, 1 - threshold**2) ** 0.5 * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        q1, q2 = (_squares(x, c)[0] for x, c in ((q[None, :half], books[0]), (q[None, half:], books[1])))
        p1, p2 = _squares(near[:, :half], books[0]), _squares(near[:, half:], books[1])
        there = q1[p1.argmin(axis=1)] + q2[p2.argmin(axis=1)] - q1.min() - q2.min()
        back = p1[:, q1.argmin()] + p2[:, q2.argmin()] - p1.min(axis=1) - p2.min(axis=1)
        out.append(np.minimum(there, back))
    return np.sort(np.concatenate(out))


def _celled(books: tuple[np.ndarray, np.ndarray], reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1))
            half = x.shape[1] // 2
            d1, d2 = _squares(x[:, :half], books[0]), _squares(x[:, half:], books[1])
            cells = [traverse(d1[k], d2[k], reach).tolist() for k in range(len(x))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return run


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node in reach by the edges (i, j)."""
    up = np.arange(n)
    while True:
        a, b = up[i], up[j]
        if (a == b).all():
            return up
        least = np.minimum(a, b)
        np.minimum.at(up, a, least)
        np.minimum.at(up, b, least)
        while (up[up] != up).any():
            up = up[up]


def _block(threshold: float):
    """Links between visitors and residents of one cell block: per vector its count, and edges of a spanning forest."""

    def run(key, data):
        home = data.column("home").to_numpy()
        x = _unit(data.column("v"))
        rep, weight = data.column("rep").to_numpy(), data.column("weight").to_numpy()
        cells, starts = _firsts(data.column("cells"))
        residents, visitors = np.flatnonzero(home == 1), np.flatnonzero(home == 0)
        counts: dict[int, int] = {}
        up = np.arange(len(rep))
        if len(residents) and len(visitors):
            v, r = np.nonzero(x[visitors] @ x[residents].T >= threshold)
            i, j = visitors[v], residents[r]
            other = rep[i] != rep[j]
            i, j = i[other], j[other]
            # a resident that doesn't visit its visitor's own cell is told of the link here
            row = np.repeat(np.arange(len(rep)) << 32, np.diff(starts))
            told = ~np.isin((j << 32) + cells[starts[i]], row + cells)
            for one, two in ((i, j), (j[told], i[told])):
                at, back = np.unique(one, return_inverse=True)
                for k, n in zip(at, np.bincount(back, weights=weight[two], minlength=len(at)), strict=True):
                    counts[int(rep[k])] = counts.get(int(rep[k]), 0) + int(n)
            up = _labels(i, j, len(rep))
        linked = np.flatnonzero(up != np.arange(len(rep)))
        a = [*counts, *(int(rep[k]) for k in linked)]
        n = [*counts.values(), *([0] * len(linked))]
        b = [*counts, *(int(rep[up[k]]) for k in linked)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec, n_links, component_id, kept), one row per row of vectors.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, and so do rows without an id; vectors must be of one length, others than the
    most common one link with nothing. Components are compared in double precision, whatever
    their number type. component_id is the smallest id in reach, itself
    included (null without an id, and then kept). Rows that repeat an id are vectors of
    their own, linked by what they hold only. Other columns are ignored; an empty table
    gives no rows.
    """
    kind = "float" if vectors.schema[embedding].dataType == ArrayType(FloatType()) else "double"
    rows = vectors.select(F.col(vec).cast("long").alias("id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    clean = F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = table(rows.withColumn("ok", clean & F.col("id").isNotNull()))
    lengths = rows.where("ok").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    length = lengths[0][0] if lengths else 0
    ruled = rows.where(F.col("ok") & (F.size("v") == length))
    # where ids repeat, two classes may have the same smallest id: then numbers name them
    unique = ruled.groupBy("id").count().where("count > 1").isEmpty()
    name = F.col("least") if unique else F.monotonically_increasing_id()
    classes = table(ruled.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight")).select(name.alias("rep"), "least", "v", "weight"))
    n = classes.count()
    if n < 2:
        found = classes.select("rep", F.lit(0).cast("long").alias("n"), F.col("rep").alias("component"))
    else:
        links = table(_links(classes, n, threshold, kind))
        counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        components = connected_components(links.select("a", "b")).withColumnRenamed("node", "rep")
        found = classes.select("rep").join(counts, "rep", "left").join(components, "rep", "left").select("rep", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("component", "rep").alias("component"))
    of_class = classes.select("v", "rep", "least", "weight").join(found, "rep").withColumn("ok", F.lit(True))
    if not unique:
        smallest = of_class.groupBy("component").agg(F.min("least").alias("smallest"))
        of_class = of_class.join(smallest, "component").withColumn("component", F.col("smallest"))
    out = rows.join(of_class, ["v", "ok"], "left")
    component = F.coalesce("component", "id")
    n_links = F.coalesce(F.col("n") + F.col("weight") - 1, F.lit(0)).cast("long")
    return out.select(F.col("id").alias(vec), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, n: int, threshold: float, kind: str) -> DataFrame:
    scale = 1 << 30
    part = lambda rows, seed: classes.where(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(scale)) <= F.lit(min(scale, scale * rows // n)))
    sample = part(FIT_ROWS, 1).select("rep", "v").toPandas().sort_values("rep")  # about FIT_ROWS rows
    x = _unit(sample["v"].tolist())
    half, k = x.shape[1] // 2, int(np.clip(round((n / CELL_ROWS) ** 0.5), 1, min(1024, len(x))))
    books = (_centres(x[:, :half], k), _centres(x[:, half:], k))
    probes = part(PROBE_ROWS, 2).select("rep", "v").toPandas().sort_values("rep")  # about PROBE_ROWS rows
    asked = _unit(probes["v"].tolist())
    links = classes.select("rep", "v").mapInArrow(_excess(asked, probes["rep"].to_numpy(), books, threshold), "steps long, n long").groupBy("steps").agg(F.sum("n").alias("n")).toPandas().sort_values("steps")  # a row for each step at most
    made_up = _partner_excess(asked, books, threshold)
    reach = float(made_up[int(np.ceil(TARGET_RECALL * len(made_up))) - 1])
    if len(links):
        share = links["n"].cumsum() / links["n"].sum()
        reach = max(reach, STEP * float(links["steps"][share >= TARGET_RECALL].iloc[0]))
    spread = table(classes.select("rep", "v", "weight").mapInArrow(_celled(books, reach + 1e-12), f"rep long, v array<{kind}>, weight long, cells array<long>"))
    sizes = spread.groupBy(F.col("cells")[0].alias("cell")).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("asked"))
    visits = spread.withColumn("cell", F.explode("cells"))
    asking = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("asking"))
    blocks = table(sizes.join(asking, "cell"))  # a row for each cell at most
    h = F.xxhash64("rep")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    visitors = visits.join(blocks, "cell").select("cell", F.pmod(h, F.col("asking")).cast("int").alias("i"), F.explode(each("asked")).alias("j"), F.lit(0).alias("home"), "rep", "v", "weight", F.slice("cells", 1, 1).alias("cells"))
    residents = spread.withColumn("cell", F.col("cells")[0]).join(blocks, "cell").select("cell", F.explode(each("asking")).alias("i"), F.pmod(h, F.col("asked")).cast("int").alias("j"), F.lit(1).alias("home"), "rep", "v", "weight", "cells")
    return visitors.union(residents).groupBy("cell", "i", "j").applyInArrow(_block(threshold), "a long, b long, n long")


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings at a cosine of 0.9."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE clean AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id <= coalesce(l.b, vec_id) AS kept
FROM clean LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""
