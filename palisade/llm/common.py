"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.sources.tables import spread

#: Runs of space and of the five control characters from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times in `body`.

    A lambda variable is evaluated once, whereas an alias that is used inside a
    lambda can be inlined by the optimizer and evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The blank-separated words of a text; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only, whatever the locale and the other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only on one machine, and where none is set."""
    context = spark.sparkContext
    where = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        where = "/tmp/palisade-checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


_left: set[str] = set()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that is written and read again.

    What is still there when the driver ends is deleted then: results that read it are lazy,
    so it cannot go before.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


@atexit.register
def _clear() -> None:
    while _left:
        _delete(_left.pop())


def _delete(path: str) -> None:
    jvm, active = SparkContext._gateway.jvm, SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage at a table in the shared folder, which survives lost executors.

    Written as Parquet rather than by checkpoint(): smaller, and the size that the
    files report lets Spark choose a join by what is really there.
    """
    return settled_at(df)[0]


def settled_at(df: DataFrame) -> tuple[DataFrame, str]:
    """`settled` with the path, for tables that are discarded before the work is over."""
    spark = df.sparkSession
    path = scratch(spark, "settled")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's own file systems."""
    _delete(path)
    _left.discard(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted now rather than at some later time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies.

    On a cluster the package is sent with --py-files; there the extra path is ignored.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
