"""A corpus from raw documents: quality, line dedup, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before has kept; all
but the last return the columns of documents. run() writes each stage's result as Parquet
in the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirgauge.llm import common, line_dedup, minhash, mixing, packing, quality


def keep_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null texts score as empty ones, rows that repeat score alike."""
    with common.scope(spark, "quality"):
        model = quality.train(docs, common.read(spark, sf_dir, "labels"))
        return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks that earlier documents have; texts of which no word is left go.

    Null and wordless texts that lost nothing stay; rows that repeat id and text are one
    document here, so they lose nothing to each other.
    """
    with common.scope(spark, "line_dedup", after="quality"):
        out = line_dedup.dedup_lines(docs, removed="_removed").where((F.col("_removed") == 0) | F.col("text").rlike(common.WORD))
        out = out.withColumn("n_chars", F.when(F.col("_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
        return out.select(*docs.columns)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, a similarity of 0.8 or more).

    That is the one of the smallest id; of several texts of that id the one of the least
    hash, and of rows that repeat id and text any. Texts without words and rows without an
    id form no groups and stay, but rows that repeat id and text stay once.
    """
    with common.scope(spark, "near_duplicates", after="line_dedup"):
        found = common.table(minhash.near_duplicates(docs, words=5, percent=80, detail=True))
        first = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
        stay = first.select("first.row_key").union(found.where("group is null").select("row_key"))
        key = common.fresh(docs, "_row_key")
        kept = docs.withColumn(key, minhash.row_key("doc_id", "text")).join(stay.withColumnRenamed("row_key", key), key, "left_semi")
        repeated = not found.groupBy("row_key").count().where("count > 1").isEmpty()
        return (kept.dropDuplicates([key]) if repeated else kept).select(*docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, texts without words aren't taken."""
    with common.scope(spark, "source_mix", after="near_duplicates"):
        return mixing.apply_copies(docs, mixing.mix(docs))


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; a null or empty text is one token, rows that repeat are packed each."""
    with common.scope(spark, "packing", after="source_mix"):
        return packing.pack_byte_bpe(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The stages hold models and alignments, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.table_beside(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
