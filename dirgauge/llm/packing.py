"""Packing documents into windows by non-negative least squares.

Documents are tokenized once. Whole windows are cut off the front of long documents; what
is left of each document is a piece shorter than a window. Lengths of pieces fall into
classes; combinations of a few classes that fill a window are enumerated, their repeat
counts are solved for by non-negative least squares against the histogram of classes, and
rounded down. Each planned window takes its pieces whole, so that it has at most a few
tokens of padding a piece. Pieces that no planned window takes are packed greedily, one
after the other into the open window, cut where it ends.

Only the histogram (at most WINDOW / CLASS counts) and the plan come to the driver. Pieces
find their place in the plan by their rank in their class, which is summed up over salted
parts, so that a class with a third of all rows is spread.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirgauge.llm.common import read, table
from dirgauge.llm.textkeys import PIECE_BYTES

WINDOW = 2048
CLASS = 8
END_ID = 1
#: Salted parts at least, and rows of one, about.
SALTS, PART_ROWS = 32, 250_000
#: Streams whose sizes one task sums up.
STREAM_BLOCK = 4096
#: Greedily packed windows a task's stream has, about.
STREAM_WINDOWS = 64
CACHE = 900_000

#: White space other than single spaces and line feeds between words: such texts are encoded whole.
_ODD = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


class Encoder:
    """Token ids as bytes of unsigned 32-bit little-endian numbers, with a cache by word.

    A byte-level pre-tokenizer never joins text across a single space or line feed that
    stands between two other characters than white space: the space begins the next
    pre-token, the line feed is one by itself. So words are encoded once each and looked
    up; a text with other white space, or with a string that is a token of its own
    wherever it stands, is encoded as a whole.

    ranks and pattern name the same vocabulary for a library that is quicker at single words.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are a token of their own wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.feed = self._whole(["\n"])[0]
        self.quick = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.feed_id = int(np.frombuffer(self.feed, dtype="<u4")[0])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _listed(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of each of words after lead, encoded as one text; the line feeds between them are tokens of their own."""
        if not words:
            return []
        text = lead + f"\n{lead}".join(words)
        ids = np.array(self.quick.encode_ordinary(text) if self.quick else self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = [*(np.flatnonzero(ids == self.feed_id) * 4).tolist(), 4 * len(ids)]
        raw, begin, out = ids.tobytes(), 0, []
        for end in ends:
            out.append(raw[begin:end])
            begin = end + 4
        return out

    def _odd(self, text: str) -> bool:
        return not text or any(t in text for t in self.added) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _ODD.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A word is looked up as it stands, one at a line's begin with the line feed before it, a text's first as a line's."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        split = [None if self._odd(t) else f"\n{t}".replace("\n", " \n").split(" ")[1:] for t in texts]
        new: set[str] = set()
        for words in split:
            if words:
                new |= set(words).difference(known)
        inner = [w for w in new if w[0] != "\n"]
        begin = [w for w in new if w[0] == "\n"]
        known.update(zip(inner, self._listed(inner, " "), strict=True))
        known.update(zip(begin, [self.feed + x for x in self._listed([w[1:] for w in begin], "")], strict=True))
        whole = iter(self._whole([t for t, words in zip(texts, split, strict=True) if words is None]))
        of, skip = known.__getitem__, len(self.feed)
        return [next(whole) if words is None else b"".join(map(of, words))[skip:] for words in split]


_encoders: dict[str, Encoder] = {}


def _tokenized(path: str, window: int, end_id: int, ranks: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path, ranks, pattern))
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * window
        for batch in batches:
            row = 0
            while row < batch.num_rows:
                texts, size, begin = [], 0, row
                while row < batch.num_rows and (size < PIECE_BYTES or row == begin):
                    texts.append(batch.column(1)[row].as_py() or "")
                    size += len(texts[-1])
                    row += 1
                total, crcs, left, left_ids = [], [], [], []
                for ids in encoder.encode(texts):
                    ids += end
                    full = len(ids) // step
                    total.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[k * step : (k + 1) * step]) for k in range(full)])
                    left_ids.append(ids[full * step :])
                    left.append(zlib.crc32(left_ids[-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, row - begin), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(left, pa.int64()), pa.array(left_ids, pa.binary())],
                    names=["uid", "doc_tokens", "full_crcs", "left_crc", "left_ids"],
                )

    return run


def combinations(classes: int, depth: int = 8) -> list[tuple[int, ...]]:
    """Multisets of classes 1..classes that sum up to classes: of two, of three, and of up to depth with all but one alike."""
    found = {(classes,): None}
    for a in range(1, classes):
        for b in range(a, classes - a + 1):
            if a + b == classes:
                found[(a, b)] = None
            elif classes - a - b >= b:
                found[(a, b, classes - a - b)] = None
        for k in range(3, depth):
            if 0 < (b := classes - k * a):
                found[tuple(sorted([a] * k + [b]))] = None
    return list(found)


def nnls(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """x >= 0 with small |a x - b|: active sets after Lawson and Hanson. Holds no more than a and a square of its rows."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max()))
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= least:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            own = a[:, at]
            try:
                z = np.linalg.solve(own.T @ own, own.T @ b)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(own, b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12)]
            x[gone] = 0
            passive[gone] = False
            if not len(gone):
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that take no more pieces of any class than there are; histogram[k] counts class k + 1."""
    classes = len(histogram)
    combos = combinations(classes)
    held = np.zeros((classes, len(combos)))
    for c, combo in enumerate(combos):
        for k in combo:
            held[k - 1, c] += 1
    size = max(1.0, float(histogram.sum()))
    x = nnls(held, histogram / size, 2 * classes) * size
    left, out = histogram.astype(np.int64).copy(), []
    for c in np.argsort(-x, kind="stable"):
        need = held[:, c].astype(np.int64)
        n = min(int(np.floor(x[c] + 1e-6)), int((left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left -= n * need
            out.append((combos[c], n))
    return out


def _running(rows: DataFrame, amount: Column, salts: int, name: str) -> DataFrame:
    """rows(uid, ...) with name: the sum of amount over all rows before, in an order of salted parts and uid."""
    salted = rows.withColumns({"_amount": amount.cast("long"), "_salt": F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")})
    before = Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = salted.groupBy("_salt").agg(F.sum("_amount").alias("_sum")).select("_salt", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_salt").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return salted.join(parts, "_salt").withColumn(name, F.col("_before") + F.coalesce(F.sum("_amount").over(within), F.lit(0))).drop("_amount", "_salt", "_before")


def _before(rows: DataFrame, key: str, amount: str, block: int) -> DataFrame:
    """(key, base): the sum of amount over all rows of smaller keys, which are whole numbers from 0 on; block keys a task."""
    blocked = rows.withColumn("_block", F.expr(f"{key} div {block}"))
    above = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocked.groupBy("_block").agg(F.sum(amount).alias("_all")).select("_block", F.coalesce(F.sum("_all").over(above), F.lit(0)).alias("_top"))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(tops, "_block").select(key, (F.col("_top") + F.coalesce(F.sum(amount).over(within), F.lit(0))).alias("base"))


def pack(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, class_width: int = CLASS, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are those of its text (null: empty) and end_id, so that an empty
    text has one. Rows are documents of their own even if ids or texts repeat or are null.
    Other columns are ignored; an empty table gives no rows. A sequence's pieces follow
    each other without gaps from offset 0, up to window tokens.
    """
    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    # uid stays in step with the row, as the id column goes through Python beside the text
    kept = named.select(F.struct("uid", "doc").alias("uid"), "text")
    kind = kept.schema["uid"].dataType.simpleString()
    tokens = kept.mapInArrow(_tokenized(tokenizer, window, end_id, ranks, pattern), f"uid {kind}, doc_tokens long, full_crcs array<long>, left_crc long, left_ids binary")
    tokens = table(tokens.select("uid.uid", "uid.doc", "doc_tokens", "full_crcs", "left_crc", "left_ids"))
    salts = max(SALTS, tokens.count() // PART_ROWS)
    left = F.col("doc_tokens") % window
    class_of = F.ceil(left / class_width).cast("int")
    pieces = tokens.where(left > 0).select("uid", "doc", "doc_tokens", (F.col("doc_tokens") - left).alias("start"), left.alias("length"), "left_crc", class_of.alias("class"), F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"))
    parts = table(pieces.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")))
    histogram = np.zeros(-(-window // class_width), dtype=np.int64)
    for k, n in parts.groupBy("class").agg(F.sum("n")).collect():  # at most window / class_width rows
        histogram[k - 1] = n
    slots, windows = _slots(plan(histogram))

    spark = docs.sparkSession
    slot_table = spark.createDataFrame(slots, "class int, first long, last long, times long, slot int, base long")  # a few slots for each class
    rank_before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("class", "salt", F.coalesce(F.sum("n").over(rank_before), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("class", "salt").orderBy("uid")
    ranked = pieces.withColumn("rank", F.row_number().over(in_part) - 1).join(offsets, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    slot_table = slot_table.withColumnRenamed("class", "slot_class")
    fits = (F.col("class") == F.col("slot_class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked.join(F.broadcast(slot_table), fits, "left")
    nth = F.col("rank") - F.col("first")
    placed = table(placed.select("uid", "doc", "doc_tokens", "start", "length", "left_crc", (F.col("base") + F.expr("(rank - first) div times")).alias("window"), (F.col("slot") + nth % F.col("times")).alias("slot")))

    whole = tokens.where(F.size("full_crcs") > 0).select("uid", "doc", "doc_tokens", "full_crcs")
    n_whole = whole.agg(F.coalesce(F.sum(F.size("full_crcs")), F.lit(0))).first()[0]
    whole = _running(whole, F.size("full_crcs"), 2 * salts, "base").select("doc", "doc_tokens", "base", F.posexplode("full_crcs").alias("k", "crc"))
    out = whole.select("doc", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    along = Window.partitionBy("window").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    planned = placed.where("window is not null").withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long"))
    out = out.unionByName(planned.select("doc", "start", "length", F.col("left_crc").alias("ids_crc32"), "doc_tokens", (F.col("window") + n_whole).alias("sequence_id"), "offset"))

    loose = placed.where("window is null").select("uid", "doc", "doc_tokens", "start", "length")
    stray = loose.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    streams = max(1, stray // (window * STREAM_WINDOWS))
    loose = loose.withColumn("stream", F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(streams)))
    filled = _before(loose.groupBy("stream").agg(F.ceil(F.sum("length") / window).alias("n")), "stream", "n", STREAM_BLOCK)
    upto = Window.partitionBy("stream").orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = loose.withColumn("end", F.sum("length").over(upto)).withColumn("begin", F.col("end") - F.col("length")).join(filled, "stream")
    laid = laid.join(tokens.select("uid", "left_ids"), "uid").withColumn("k", F.explode(F.sequence(F.expr(f"begin div {window}"), F.expr(f"(end - 1) div {window}"))))
    cut, until = F.greatest("begin", F.col("k") * window), F.least("end", (F.col("k") + 1) * window)
    laid = laid.withColumns({"from": cut, "size": until - cut})
    ids = F.substring("left_ids", ((F.col("from") - F.col("begin")) * 4 + 1).cast("int"), (F.col("size") * 4).cast("int"))
    greedy = laid.select("doc", (F.col("start") + F.col("from") - F.col("begin")).alias("start"), F.col("size").alias("length"), F.crc32(ids).alias("ids_crc32"), "doc_tokens", (F.col("base") + F.col("k") + (n_whole + windows)).alias("sequence_id"), (F.col("from") - F.col("k") * window).alias("offset"))
    out = out.unionByName(greedy)
    return out.withColumnRenamed("doc", doc)


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(class, first rank, end rank, times in a window, first slot, first window) of each class in each combination, and how many windows."""
    used: dict[int, int] = {}
    slots, base = [], 0
    for combo, n in planned:
        slot = 0
        for k in sorted(set(combo), reverse=True):
            times = combo.count(k)
            first = used.get(k, 0)
            used[k] = first + times * n
            slots.append((k, first, used[k], times, slot, base))
            slot += times
        base += n
    return slots, base


def pack_byte_bpe(docs: DataFrame) -> DataFrame:
    """docs in sequences of at most WINDOW tokens of byte_bpe_50k.json."""
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens of byte_bpe_50k.json."""
    return pack_byte_bpe(read(spark, sf_dir, "documents"))
