"""What the operators share: tables in the shared folder, column names, word rules."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

_written: dict[str, list[str]] = {"": []}
_scope = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where that is unset, one in the warehouse."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_dirgauge"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def table(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/dirgauge-{uuid.uuid4().hex}"
    _written[_scope].append(path)
    return _through(df, path, codec)


def table_beside(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """As table(), but it stays when the scope that it is written in ends."""
    path = f"{shared_dir(df.sparkSession)}/dirgauge-{uuid.uuid4().hex}"
    _written[""].append(path)
    return _through(df, path, codec)


def _through(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession, name: str, after: str | None = None):
    """While open, tables are written under name; tables under after, of a stage that has ended, are dropped first."""
    global _scope
    if after is not None:
        drop_tables(spark, after)
    outer, _scope = _scope, name
    _written.setdefault(name, [])
    try:
        yield
    finally:
        _scope = outer


def drop_tables(spark: SparkSession, scope: str) -> None:
    _delete(_written.pop(scope, []), spark.sparkContext._jsc.hadoopConfiguration())


def _delete(paths: list[str], conf) -> None:
    for path in paths:
        where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@atexit.register
def _drop_all() -> None:
    """Results may be read as long as the program runs; with it, its tables go."""
    if SparkContext._jvm is not None and any(_written.values()):
        try:
            _delete([p for paths in _written.values() for p in paths], SparkContext._jvm.org.apache.hadoop.conf.Configuration())
        except Exception as e:  # the JVM may have ended before
            print(f"Tables of this run may be left in the shared folder: {type(e).__name__}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name like wanted that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def sort_key(*columns: Column) -> Column:
    """A struct that orders rows the same way on every run."""
    return F.struct(*columns)
