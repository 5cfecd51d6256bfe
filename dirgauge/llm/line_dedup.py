"""Line dedup: remove from a document the blocks of lines that an earlier one has.

Lines are compared as sequences of words. A window is the shortest run of lines of enough
words from a line on, or up to a line. For each window in more than one document, every
later document is paired with the first that has it; so there are at most two pairs a
line, however common it is. Every common run of enough words is made of such windows, so
the first holders of a document's windows have all that any earlier document has of it.
Each pair is aligned by patience diff: lines that are unique on both sides and in the
longest common order are anchors, the stretches between are aligned in the same way, and
equal lines beside anchors join them. Aligned runs of enough words go from the later
document. What is not aligned (repeated or in another order) goes if it lies in a window
that the earlier document has anywhere. The first document that holds a line never loses
it, so that one copy stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirgauge.llm.common import fresh, read, table
from dirgauge.llm.textkeys import _powers_to, lists, mix, signed, text_pieces, word_places

MIN_WORDS = 50


_FACTOR = np.uint64(0x9FB21C651E98DF25)


def _line_keys(least: int):
    """(at, keys, words, windows): for each line of each text, a hash of its words and their number (0 and 0 for a blank line); the text's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.cumprod(np.full(64, _FACTOR))
        for batch in batches:
            keys, counts, runs = [], [], []
            for _, _, data, offsets in text_pieces(batch.column(1)):
                hashes, begin = word_places(data, offsets, fold=False)
                feeds = np.flatnonzero(data == 0x0A)
                feed_of = np.searchsorted(feeds, offsets)
                for k in range(len(offsets) - 1):
                    starts = np.concatenate((offsets[k : k + 1], feeds[feed_of[k] : feed_of[k + 1]] + 1, offsets[k + 1 : k + 2]))
                    first = np.searchsorted(begin, starts)
                    n = np.diff(first)
                    own = hashes[first[0] : first[-1]]
                    place = np.arange(len(own)) - np.repeat(first[:-1] - first[0], n)
                    if len(own) and len(power) <= place.max():
                        power = np.cumprod(np.full(int(place.max()) + 1, _FACTOR))
                    sums = np.zeros(len(own) + 1, dtype=np.uint64)
                    np.cumsum(own * power[place], out=sums[1:])
                    line = mix(np.diff(sums[first - first[0]]) + n.astype(np.uint64))
                    line[n == 0] = 0
                    keys.append(signed(line))
                    counts.append(n)
                    runs.append(signed(np.unique(windows(keys[-1], n, least)[2])) if len(own) >= least else keys[-1][:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(keys, pa.int64()), lists(counts, pa.int64()), lists(runs, pa.int64())], names=["at", "keys", "words", "windows"])

    return run


def windows(keys: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, hash) of the shortest runs of at least so many words from each line on and up to each line."""
    n, least = len(keys), max(1, least)
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(total, total[:-1] + least)
    from_line = np.flatnonzero(end <= n)
    first = np.searchsorted(total, total[1:] - least, side="right") - 1
    to_line = np.flatnonzero(first >= 0)
    lo = np.concatenate((from_line, first[to_line]))
    hi = np.concatenate((end[from_line], to_line + 1))
    power, inverse = _powers_to(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    # a blank line counts as well
    np.cumsum(mix(keys.view(np.uint64) + _FACTOR) * power[:n], out=sums[1:])
    return lo, hi, mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def _anchors(a: list[int], b: list[int], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """Positions of lines unique in both stretches, in their longest common order; blank lines are no anchors."""
    in_a, in_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
    where = {x: j for j, x in enumerate(b[lo_b:hi_b], lo_b) if x and in_b[x] == 1}
    pairs = [(i, where[x]) for i, x in enumerate(a[lo_a:hi_a], lo_a) if in_a[x] == 1 and x in where]
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, ascending in both."""
    matched, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            matched.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            matched.append((hi_a, hi_b))
        if lo_a == hi_a or lo_b == hi_b:
            continue
        last_a, last_b = lo_a, lo_b
        for i, j in (found := _anchors(a, b, lo_a, hi_a, lo_b, hi_b)):
            matched.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        if found:
            todo.append((last_a, hi_a, last_b, hi_b))
    return sorted(matched)


def common_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Positions in b, ascending, of the runs of at least so many words that a has as well; words is b's.

    Aligned runs first; then, where lines are left, all that lie in a window that a has.
    """
    out, run = set(), []
    for i, j in [*patience(a, b), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[k] for _, k in run) >= least:
                out.update(k for _, k in run)
            run = []
        run.append((i, j))
    if len(out) < len(b):
        of = dict(zip(b, words, strict=True))
        a_words = [of.get(x, least) for x in a]  # a line that b lacks is in no common window
        _, _, held = windows(np.array(a, dtype=np.int64), np.array(a_words, dtype=np.int64), least)
        lo, hi, runs = windows(np.array(b, dtype=np.int64), np.array(words, dtype=np.int64), least)
        common = np.isin(runs, held)
        depth = np.zeros(len(b) + 1, dtype=np.int64)
        np.add.at(depth, lo[common], 1)
        np.add.at(depth, hi[common], -1)
        out.update(np.flatnonzero(np.cumsum(depth[:-1]) > 0).tolist())
    return sorted(out)


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            found = [common_blocks(a, b, words, least) for a, b, words in rows]
            keep = [k for k, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([found[k] for k in keep], pa.list_(pa.int64()))], names=["at", "gone"])

    return run


def _identity(doc: str, text: str) -> Column:
    """Names a document and orders documents: its id, then a hash of id and text."""
    return F.struct(F.col(doc).cast("long").alias("doc"), F.xxhash64(F.col(doc), F.col(text)).alias("key"))


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "n_removed") -> DataFrame:
    """docs with the repeated blocks gone from text, and the number of lines gone in removed.

    Earlier documents are those with smaller ids (nulls first, equal ids by a hash of the
    text); rows that repeat both id and text are one document. Lines end at line feeds and
    are equal if their words (between ASCII white space) are. A block goes if it holds at
    least min_words words; lines repeated within one document stay. Null and empty texts
    stay as they are; an empty table stays empty.
    """
    named = docs.select(_identity(doc, text).alias("at"), F.col(text).alias("text"))
    known = table(named.mapInArrow(_line_keys(min_words), "at struct<doc:bigint,key:bigint>, keys array<long>, words array<long>, windows array<long>"))
    spread = known.select("at", F.explode("windows").alias("window"))
    # written first, so that the join has a stage of its own, in which a very common window can be split
    first = table(spread.groupBy("window").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select("window", "first"))
    pairs = table(spread.join(first.hint("merge"), "window").where("at <> first").select("at", "first").distinct())
    repeated = not known.groupBy("at").count().where("count > 1").isEmpty()
    lines = known.select("at", "keys", "words")
    lines = table(lines.dropDuplicates(["at"])) if repeated else lines
    # no side has a proven size bound, so none is broadcast, and the plan is the same at every size
    sides = pairs.hint("merge").join(lines.select(F.col("at").alias("first"), F.col("keys").alias("first_keys")), "first").hint("merge").join(lines, "at")
    gone = sides.select("at", "first_keys", "keys", "words").mapInArrow(_align(min_words), "at struct<doc:bigint,key:bigint>, gone array<long>")
    gone = table(gone.groupBy("at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")))
    at, cut = fresh(docs, "_dg_at"), fresh(docs, "_dg_gone")
    out = docs.withColumn(at, _identity(doc, text)).join(gone.withColumnsRenamed({"at": at, "gone": cut}).hint("merge"), at, "left")
    parts = F.split(F.col(text), "\n")
    rest = F.when(F.size(cut) == F.size(parts), F.lit("")).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(cut, i.cast("long"))), "\n"))
    out = out.withColumns({text: F.when(F.col(cut).isNull(), F.col(text)).otherwise(rest), removed: F.coalesce(F.size(cut), F.lit(0)).cast("long")})
    return out.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*docs.columns, removed])])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, without blocks of 50 words or more that an earlier one has."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_removed", F.length("text").cast("long").alias("n_chars"))


ORACLE_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, lines, list_transform(lines, lambda t: regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM cut),
known AS (SELECT doc_id, lines, list_transform(w, lambda x: array_to_string(x, ' ')) AS norm, list_transform(w, lambda x: len(x)) AS n FROM worded),
places AS (SELECT doc_id, unnest(n) AS own, generate_subscripts(n, 1) AS i FROM known),
counted AS (SELECT doc_id, i, sum(own) OVER along AS upto, sum(own) OVER along - own AS before FROM places WINDOW along AS (PARTITION BY doc_id ORDER BY i)),
ends AS (SELECT doc_id, upto, min(i) AS i FROM counted GROUP BY 1, 2),
begins AS (SELECT doc_id, before, max(i) AS i FROM counted GROUP BY 1, 2),
windows AS (
  SELECT a.doc_id, a.i AS lo, b.i AS hi FROM (SELECT doc_id, i, before + 50 AS want FROM counted) a ASOF JOIN ends b ON a.doc_id = b.doc_id AND a.want <= b.upto
  UNION SELECT a.doc_id, b.i, a.i FROM (SELECT doc_id, i, upto - 50 AS want FROM counted) a ASOF JOIN begins b ON a.doc_id = b.doc_id AND a.want >= b.before),
runs AS (SELECT doc_id, lo, hi, array_to_string(norm[lo:hi], chr(10)) AS run FROM windows JOIN known USING (doc_id)),
firsts AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run),
covered AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM runs JOIN firsts USING (run) WHERE first < doc_id),
gone AS (SELECT doc_id, list(i) AS cut_at FROM covered GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS rest FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM known SEMI JOIN gone USING (doc_id)) ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id),
done AS (SELECT d.doc_id, CASE WHEN cut_at IS NULL THEN text ELSE coalesce(rest, '') END AS text, coalesce(len(cut_at), 0)::BIGINT AS n_removed FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id))
SELECT doc_id, text, n_removed, length(text) AS n_chars FROM done
"""
