"""Mixing sources to target weights by entropy balancing.

Every document d has a rate r_d from 0 to most, how often the mix takes it. Among all rates
that meet each source's word target, entropy balancing takes those closest to 1 in relative
entropy, weighted by document size:

    min  sum_d size_d (r_d log r_d - r_d + 1)   with  sum_{d in s} size_d r_d = target_s

Its dual is convex with one multiplier a constraint, and its solution tilts exponentially:
r_d = min(most, exp(lambda_s(d))). Constraints on further columns (a language, say) may
overlap with those on sources; their multipliers add up, so that rates differ within a
source. Newton iterates on the dual: each step takes its gradient and its curvature, which
within one column's constraints is diagonal, as a distributed sum over all cells of
documents with the same constraints, one column after the other, until all are met.

Rates become whole copies by systematic rounding: along an order of a cell's documents
by size, the running count of copies stays within one of the running sum of rates, so a
source misses its target by about its largest document at most. A few repair rounds then
add or take back the one copy per source that closes most of what is missing.

Only DataFrame functions are used. Ranks within a cell are found in parts (size class and
salt, more salts for more rows) whose counts are summed, so that a source with a third of
all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirgauge.llm.common import WORD, fresh, read, table

NEWTON_STEPS, TOLERANCE = 80, 1e-9
REPAIRS = 4
#: Rows of one salted part, about, where no size class is larger than others.
PART_ROWS = 250_000


def words_in(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weigh(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sources(source, source_size) with weight and target.

    Sources by code point, null last, take the weights in turn. Targets share the sum of
    all sizes by weight; none passes most times its source's size, and the excess goes to
    the others by weight. That is one water level w: target = min(most * size, weight * w).
    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    whole = Window.partitionBy()
    table_ = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int") + 1))
    table_ = table_.withColumns({"_cap": F.col("source_size") * F.lit(most), "_all": F.sum("source_size").over(whole).cast("double")})
    table_ = table_.withColumn("_full", F.col("_cap") / F.col("weight"))
    below = Window.orderBy("_full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    table_ = table_.withColumns({"_used": F.coalesce(F.sum("_cap").over(below), F.lit(0.0)), "_gone": F.coalesce(F.sum("weight").over(below), F.lit(0.0)), "_weights": F.sum("weight").over(whole)})
    level = (F.col("_all") - F.col("_used")) / (F.col("_weights") - F.col("_gone"))
    table_ = table_.withColumn("_level", F.max(F.when(level <= F.col("_full"), level)).over(whole))
    target = F.least(F.col("_cap"), F.col("weight") * F.coalesce("_level", F.lit(float("inf"))))
    return table_.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def balance(cells: DataFrame, targets: dict[str, DataFrame], most: float) -> DataFrame:
    """cells with rate, from 0 to most, so that the sums of size * rate meet all targets.

    cells have a column for each name in targets and a size; targets[name] has name and
    target, once each. Cells of a value without a positive target have rate 0. Targets that
    no rates meet together are missed: the iteration ends after NEWTON_STEPS.
    """
    live = cells.where("size > 0")
    duals = {}
    for name, wanted in targets.items():
        duals[name] = table(wanted.where("target > 0").join(live.select(name).distinct(), name, "left_semi").select(name, "target", F.lit(0.0).alias("_l"), F.lit(float("inf")).alias("_gap")))

    def tilted() -> DataFrame:
        out = live
        for k, name in enumerate(targets):
            out = out.join(duals[name].select(name, F.col("_l").alias(f"_l{k}")), name)
        return out.withColumn("_tilt", F.exp(sum((F.col(f"_l{k}") for k in range(len(targets))), F.lit(0.0))))

    for _ in range(NEWTON_STEPS):
        worst = 0.0
        for name in targets:
            free = F.col("_tilt") < most
            sums = tilted().groupBy(name).agg(F.sum(F.col("size") * F.least("_tilt", F.lit(float(most)))).alias("_mass"), F.sum(F.when(free, F.col("size") * F.col("_tilt")).otherwise(0.0)).alias("_free"))
            gradient = F.col("target") - F.col("_mass")
            step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), gradient / F.greatest("_free", F.lit(1e-9))))
            met = F.abs(gradient) <= TOLERANCE * F.col("target")
            duals[name] = table(duals[name].select(name, "target", "_l").join(sums, name).select(name, "target", (F.col("_l") + F.when(met, 0.0).otherwise(step)).alias("_l"), (F.abs(gradient) / F.col("target")).alias("_gap")))
            worst = max(worst, duals[name].agg(F.max("_gap")).first()[0] or 0.0)
        if worst <= TOLERANCE:
            break
    rates = tilted().select(*targets, F.least("_tilt", F.lit(float(most))).alias("rate"))
    return cells.join(rates, list(targets), "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def _named(value: Column) -> Column:
    """A text for each value, null included."""
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), value.cast("string")))


def row_hash(doc: str, source: str, text: str) -> Column:
    return F.xxhash64(F.col(doc), F.col(source), F.col(text))


def mix(docs: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, also: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc, source, row_hash, size, source_size, target, rate, copies, taken), one row per row of docs.

    size counts words. Equal rows count as so many documents. A null source is a source of
    its own; documents without words, and all documents of a source without words, get no
    copies. Copies go from 0 to most. Reruns agree: ties are broken by hashes of doc,
    source and text, so that only equal rows can change places. also[column] has further
    targets (column, target) in words by another column of docs; values without one get no
    copies. Other columns are ignored. An empty table gives no rows.
    """
    also = also or {}
    groups = {"_key": F.col(source), **{f"_also{k}": F.col(c) for k, c in enumerate(also)}}
    rows = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), row_hash(doc, source, text).alias("row_hash"), *[_named(c).alias(k) for k, c in groups.items()])
    rows = table(rows.withColumns({"_class": F.floor(F.log2(F.greatest("size", F.lit(1))) * 4).cast("int"), "_uid": F.monotonically_increasing_id()}))
    salts = max(16, rows.count() // PART_ROWS)
    rows = rows.withColumn("_salt", F.pmod("row_hash", F.lit(salts)).cast("int"))
    cell = list(groups)
    parts = table(rows.groupBy(*cell, "_class", "_salt").agg(F.min("source").alias("source"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    sizes = parts.groupBy("_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    weighed = table(weigh(sizes.select("source", "source_size"), weights, float(most)).select(_named(F.col("source")).alias("_key"), "source_size", "target"))
    targets = {"_key": weighed.select("_key", "target"), **{f"_also{k}": t.select(_named(F.col(c)).alias(f"_also{k}"), F.col("target").cast("double").alias("target")) for k, (c, t) in enumerate(also.items())}}
    rates = table(balance(parts.groupBy(*cell).agg(F.sum("size").alias("size")), targets, most).select(*cell, "rate"))
    before = Window.partitionBy(*cell).orderBy(F.col("_class").desc(), "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*cell, "_class", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")).join(rates, cell).join(weighed, "_key")
    within = Window.partitionBy(*cell, "_class", "_salt").orderBy(F.col("size").desc(), "row_hash", "_uid")
    ranked = rows.withColumn("_rank", F.row_number().over(within)).join(offsets, [*cell, "_class", "_salt"])
    upto = lambda k: F.floor(F.col("rate") * k + F.lit(0.5))
    rank = F.col("_before") + F.col("_rank")
    copies = F.least(F.lit(most), F.when(F.col("size") > 0, upto(rank) - upto(rank - 1)).otherwise(0)).cast("int")
    copied = table(ranked.withColumn("copies", copies).drop("_class", "_salt", "_rank", "_before", *cell[1:]))
    return _repaired(copied, weighed, most).select(F.col("doc").alias(doc), F.col("source").alias(source), "row_hash", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _repaired(copied: DataFrame, weighed: DataFrame, most: int) -> DataFrame:
    """copied after REPAIRS rounds in which each source changes one row by one copy.

    Of the rows that can give or take a copy, that is the largest that doesn't
    overshoot what is missing, or else the smallest that still brings the source nearer.
    The changes are a table of at most REPAIRS rows a source.
    """
    narrow = copied.where("size > 0").select("_key", "row_hash", "_uid", "size", "copies")
    taken = copied.groupBy("_key").agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"))
    missing = table(weighed.join(taken, "_key").select("_key", (F.col("target") - F.col("_taken")).alias("_miss")))
    changes = None
    for _ in range(REPAIRS):
        rows = narrow.join(missing, "_key")
        if changes is not None:
            rows = rows.join(changes.select("_key", "_uid"), ["_key", "_uid"], "left_anti")
        can = F.when(F.col("_miss") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        one, gap = F.struct("size", "row_hash", "_uid"), F.abs("_miss")
        found = rows.where(can & (F.col("size") < 2 * gap)).groupBy("_key").agg(F.max(F.when(F.col("size") <= gap, one)).alias("under"), F.min(F.when(F.col("size") > gap, one)).alias("over"), F.max("_miss").alias("_miss"))
        new = table(found.withColumn("pick", F.coalesce("under", "over")).select("_key", "pick._uid", F.signum("_miss").cast("int").alias("_add"), (F.signum("_miss") * F.col("pick.size")).alias("_got")))
        changes = new if changes is None else changes.union(new)
        missing = table(missing.join(new.select("_key", "_got"), "_key", "left").select("_key", (F.col("_miss") - F.coalesce("_got", F.lit(0.0))).alias("_miss")))
    changed = copied.join(changes.select("_key", "_uid", "_add"), ["_key", "_uid"], "left")
    return changed.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(most), F.col("copies") + F.coalesce("_add", F.lit(0)))))


def apply_copies(docs: DataFrame, mixed: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs as often as the mix takes them.

    Rows of equal doc, source and text share their copies evenly; what is left over goes to
    one of them. Columns of any other name may be there; an empty table stays empty.
    """
    key, times, uid, n, one = (fresh(docs, f"_dg_{c}") for c in ("hash", "copies", "uid", "n", "one"))
    often = table(mixed.groupBy(F.col("row_hash").alias(key)).agg(F.sum("copies").alias(times), F.count(F.lit(1)).alias(n)).where(F.col(times) > 0))
    keyed = docs.withColumn(key, row_hash(doc, source, text)).join(often, key)
    every = lambda df: df.withColumn(n, F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
    if often.where(F.col(n) > 1).isEmpty():
        return every(keyed)
    # written, so that the row that takes what is left over is the same wherever it is read
    equal = table(keyed.where(F.col(n) > 1).withColumn(uid, F.monotonically_increasing_id()))
    chosen = equal.groupBy(key).agg(F.min(uid).alias(uid)).withColumn(one, F.lit(True))
    own = F.floor(F.col(times) / F.col(n)) + F.when(F.col(one), F.col(times) % F.col(n)).otherwise(0)
    shared = equal.join(chosen, [key, uid], "left").withColumn(times, own).where(F.col(times) > 0)
    return every(keyed.where(F.col(n) == 1)).unionByName(every(shared))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 1, 2, 3 in turn, at most three copies each."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
