"""Tables that plans share, written as Parquet in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_kept: dict[tuple, tuple[str, DataFrame]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_dirgauge").rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write df and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/dirgauge-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, lengths and times of change of input files or folders: equal for equal inputs."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        store = where.getFileSystem(conf)
        if store.exists(where):
            out.append((p, store.getContentSummary(where).getLength(), store.getFileStatus(where).getModificationTime()))
    return tuple(out)


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build makes, written at the first call with key in this application, and again if it was taken away."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept or not state(spark, [f"{_kept[key][0]}/_SUCCESS"]):
        df = table(build())
        _kept[key] = _written[-1], df
    return _kept[key][1]


@atexit.register
def _drop_all() -> None:
    if SparkContext._jvm is not None and _written:
        try:
            conf = SparkContext._jvm.org.apache.hadoop.conf.Configuration()
            for path in _written:
                where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        except Exception as e:  # the JVM may have ended before
            print(f"Tables of this run may be left in the shared folder: {type(e).__name__}")
