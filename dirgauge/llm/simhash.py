"""Document fingerprints: SimHash over words and runs of words, and a search by Hamming radius.

Terms are words, pairs and triples of words; in short texts also runs of bytes, so that
they have enough. The weight of those fades out with the length of the text, byte by byte,
so that near copies have near votes at every length. Each distinct term votes on every bit of the fingerprint with its weight
times one plus the whole part of the logarithm of its frequency; a bit is set if the votes for it are positive.

The search puts fingerprints into permuted block tables: bits are cut into blocks, and if
two fingerprints differ in at most radius bits, at least blocks - radius blocks are equal.
Each choice of so many blocks is a table whose key holds them. A stated set of queries is
looked up in all tables; equal keys are candidates, and all within the radius are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirgauge.llm.common import fresh, read, table
from dirgauge.llm.textkeys import BYTE_VALUES, mix, shingles, text_pieces, words

BITS = 128
#: Weights of words, pairs, triples; of runs of bytes, by length of the run, in full in texts of up to SHORT bytes and none from LONG bytes on.
TERM_WEIGHTS = {1: 1, 2: 2, 3: 2}
SHORT, LONG, BYTE_WEIGHTS = 400, 1000, {2: 1, 4: 1}
#: Low bits of a term's hash that count; the bits above hold the text's number among up to GROUP.
HASH_BITS = 52
GROUP = 1 << (64 - HASH_BITS)
#: One bit in each byte of a 64-bit value: eight counters, which hold sums of up to 255 values.
_EVERY_BYTE, _FULL = np.uint64(0x0101010101010101), 255

#: Bits that a search reaches, blocks of its tables, and which ids ask in the production query.
RADIUS, BLOCKS, QUERY_EVERY = 3, 5, 20
#: Documents of one part of the order by id, parts at most, and how many bounds of parts form a group.
PART_ROWS, MAX_PARTS, FAN = 1000, 65_536, 256


def _ones(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each run of values (lengths are positive) how many have each of BITS hash bits set."""
    blocks = -(-lengths // _FULL)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts, blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * _FULL
    out = np.empty((len(starts), BITS // 64, 8, 8), dtype=np.int64)
    for k in range(BITS // 64):
        spread = mix(values + np.uint64(64 * k + 1))
        for j in range(8):
            sums = np.add.reduceat((spread >> np.uint64(j)) & _EVERY_BYTE, at)
            out[:, k, :, j] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(len(starts), BITS)


def _vote(out: np.ndarray, hashes: np.ndarray, owner: np.ndarray, weight: int) -> None:
    """Adds to out (texts by bits) the votes of each text's distinct terms.

    A term that a text has n times votes 1 + floor(log2(n)) times. All sums are of whole
    numbers, so that equal texts have equal votes whatever texts they are handled with.
    """
    if not len(hashes):
        return
    mask = np.uint64((1 << HASH_BITS) - 1)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes & mask))
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.frexp(np.diff(begins, append=len(keys)))[1]
    keys = np.repeat(keys[begins], times)
    texts = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
    lengths = np.diff(starts, append=len(keys))
    out[texts[starts]] += weight * (2 * _ones(keys & mask, starts, lengths) - lengths[:, None])


def _runs(out: np.ndarray, values: np.ndarray, owner: np.ndarray, weights: dict[int, int], kind: int) -> None:
    """Votes of the runs of each length in weights, within one text each."""
    for n, weight in weights.items():
        if len(values) >= n:
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            _vote(out, mix(shingles(values, n)[inside] + np.uint64(n + kind)), owner[n - 1 :][inside], weight)


def votes(hashes: np.ndarray, begins: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the signed votes on each bit for up to GROUP texts that lie end to end; begins are their words' places."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), BITS), dtype=np.int64)
    _runs(out, hashes, np.repeat(np.arange(len(sizes)), np.diff(begins)), TERM_WEIGHTS, 0)
    # whole numbers: votes of words count LONG - SHORT times, those of bytes as often as the length leaves them
    out *= LONG - SHORT
    owner = np.repeat(np.arange(len(sizes)), sizes)
    short = np.repeat(sizes < LONG, sizes)
    of_bytes = np.zeros_like(out)
    _runs(of_bytes, BYTE_VALUES[False][data[short]], owner[short], BYTE_WEIGHTS, 64)
    out += np.clip(LONG - sizes, 0, LONG - SHORT)[:, None] * of_bytes
    return out


def fingerprints(texts: pa.Array) -> pa.Array:
    """For each text BITS bits, as a list of signed 64-bit numbers; null texts are empty, empty ones have no bit set."""
    out = [np.zeros((0, BITS // 64), dtype=np.int64)]
    for _, _, data, offsets in text_pieces(texts):
        hashes, begins = words(data, offsets, fold=False)
        for k in range(0, len(offsets) - 1, GROUP):
            ends = offsets[k : k + GROUP + 1]
            at = begins[k : k + GROUP + 1]
            counted = votes(hashes[at[0] : at[-1]], at - at[0], data[ends[0] : ends[-1]], ends - ends[0])
            out.append(np.packbits(counted > 0, axis=1, bitorder="little").view(np.int64))
    flat = np.concatenate(out)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _fingerprinted(at: int, name: str):
    """Adds the fingerprints of column at as the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, name])

    return run


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and the fingerprint of text under name (array<bigint>), which df must not have.

    Null and empty texts have no bit set; equal texts have equal fingerprints in whatever
    rows they are; an empty table stays empty.
    """
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], f"`{name}` array<bigint>"])
    return df.mapInArrow(_fingerprinted(df.columns.index(text), name), schema)


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - distance(a, b) / F.lit(float(BITS))


def block_keys(fingerprint: Column, radius: int, blocks: int) -> Column:
    """The keys of a fingerprint in all tables: a hash of the table's number and its blocks (as even as hexadecimal digits allow)."""
    digits, n = as_text(fingerprint), BITS // 4
    cuts = [round(k * n / blocks) for k in range(blocks + 1)]
    parts = [F.substring(digits, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(t), *[parts[k] for k in chosen]) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def search(queries: DataFrame, prints: DataFrame, name: str = "fingerprint", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found, distance): for each distinct query each other fingerprint of prints that differs in at most radius bits.

    Equal fingerprints count once and aren't found for each other; join back on the
    fingerprint for membership. Null fingerprints neither ask nor are found. blocks must be
    more than radius and at most BITS / 4; more blocks give more tables with longer keys.
    """
    if not radius < blocks <= BITS // 4:
        raise ValueError("blocks must be more than radius, and a hexadecimal digit at least")

    def tabled(df: DataFrame, side: str) -> DataFrame:
        distinct = df.select(F.col(name)[0].alias(f"{side}0"), F.col(name)[1].alias(f"{side}1")).where(F.col(f"{side}0").isNotNull()).distinct()
        return distinct.withColumn("key", F.explode(block_keys(F.array(f"{side}0", f"{side}1"), radius, blocks)))

    query, found = F.array("q0", "q1"), F.array("f0", "f1")
    asked, held = tabled(queries, "q"), tabled(prints, "f")
    near = (asked.key == held.key) & (distance(query, found) <= radius) & ((F.col("q0") != F.col("f0")) | (F.col("q1") != F.col("f1")))
    pairs = asked.join(held, near).select("q0", "q1", "f0", "f1").distinct()
    return pairs.select(query.alias("query"), found.alias("found"), distance(query, found).alias("distance"))


def _numbers(values: list, kind: str = "bigint") -> Column:
    """values as one array that is folded to a constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _part(id_: Column, bounds: list[int]) -> Column:
    """How many of bounds (ascending) are below the id, found in two steps: among every FAN_th, then within their group; 0 for null."""
    lasts = [bounds[min(k + FAN, len(bounds)) - 1] for k in range(0, len(bounds), FAN)]
    below = lambda array: F.size(F.filter(array, lambda b: b < id_))
    group = below(_numbers(lasts))
    within = F.when(group < len(lasts), below(F.slice(_numbers(bounds), group * FAN + 1, F.lit(FAN)))).otherwise(0)
    return F.when(id_.isNull(), 0).otherwise(F.least(F.lit(len(bounds) - 1), group * FAN + within)).cast("int")


def with_next(docs: DataFrame, doc: str, columns: list[str], names: list[str], ids: DataFrame | None = None) -> DataFrame:
    """docs with the columns of the next row in descending order of doc (whole numbers) under names; the last row's next is the first.

    ids has the doc column of docs, for counts and quantiles, where that is cheaper to read than docs.

    Nulls come last; rows of equal ids are ordered by a hash of all columns. The order is cut
    into parts of about PART_ROWS rows by quantiles of the ids (MAX_PARTS at most, later
    larger ones). A quantile is an id that is there and leads its part, so rows of that id
    are known without a search, and are sent to the part before as well. A single row's next
    is itself; an empty table stays empty. Columns of any other name may be there.
    """
    ids = docs.select(F.col(doc).cast("long").alias("id")) if ids is None else ids.select(F.col(doc).cast("long").alias("id"))
    counted = ids.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).first()
    parts = int(min(MAX_PARTS, max(1, counted.n // PART_ROWS)))
    shares = _numbers([k / parts for k in range(1, parts)], "double")
    cuts = ids.agg(F.percentile_approx("id", shares, max(10_000, 10 * parts))).first()[0] if parts > 1 else None
    own, lead, at, id_ = *(fresh(docs, c) for c in ("_part", "_leads", "_at")), F.col(doc).cast("long")
    if counted.top is None:  # no id at all: one part, which its first row closes
        part, leads = F.lit(0), F.when(F.lit(True), 0)
    else:
        bounds = sorted({*(cuts or ()), counted.top})
        part = _part(id_, bounds)
        # the first row of all closes the last part, which is number 0
        leads = F.when(F.get(_numbers(bounds), F.col(own)) == id_, (F.col(own) + 1) % len(bounds))
    copies = F.array_compact(F.array(F.struct(F.col(own).alias("part"), F.lit(False).alias("extra")), F.when(F.col(lead).isNotNull(), F.struct(F.col(lead).alias("part"), F.lit(True).alias("extra")))))
    sent = docs.withColumn(own, part).withColumn(lead, leads.cast("int")).withColumn(at, F.explode(copies)).drop(own, lead)
    along = Window.partitionBy(f"{at}.part").orderBy(f"{at}.extra", F.col(doc).desc_nulls_last(), F.xxhash64(*docs.columns).desc())
    sent = sent.withColumns({name: F.lead(c).over(along) for c, name in zip(columns, names, strict=True)})
    return sent.where(~F.col(f"{at}.extra")).drop(at)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Every whole text and its edited text, the last third replaced from the next document by descending id.

    n_near: for ids divisible by QUERY_EVERY, how many other documents have a fingerprint
    within RADIUS bits, equal ones included, by the block tables; else null.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = with_next(with_fingerprint(docs, "text", "own"), "doc_id", ["text", "own"], ["next_text", "next_print"], ids=docs)
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    printed = printed.select("doc_id", n.alias("n_chars"), "own", "next_print", edited.alias("edited"))
    printed = with_fingerprint(printed, "edited", "edited_print")
    printed = table(printed.select("doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), "own", "edited_print", likeness(F.col("own"), F.col("edited_print")).alias("near_edited"), likeness(F.col("own"), F.col("next_print")).alias("near_next")))
    asks = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    held = table(printed.groupBy("own").agg(F.count(F.lit(1)).alias("times"), F.max(asks).alias("asked")))
    others = search(held.where("asked"), held, "own").join(held.select(F.col("own").alias("found"), "times"), "found").groupBy(F.col("query").alias("own")).agg(F.sum("times").alias("others"))
    near = held.where("asked").join(others, "own", "left").select("own", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_near"))
    told = printed.where(asks).join(near, "own").unionByName(printed.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
    return told.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near",
    )
