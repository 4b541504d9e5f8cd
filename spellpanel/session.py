"""Session settings and the shared place for stage tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the engine is designed around.  Sizes (partitions, memory) belong to
# the cluster; only behaviour is named here.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rule sets make thousands of column calls; do not record a call site for each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "spellpanel", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: ``spark.checkpoint.dir`` as the cluster set it.

    Where it is unset, a folder in the warehouse, which all executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def stage_folder(spark: SparkSession) -> str:
    """This application's own folder below the stage root."""
    return f"{stage_root(spark)}/spellpanel-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Cuts the lineage at a point that survives executor loss, and freezes values
    (row positions, random layout) that must not be computed twice.
    """
    path = _fresh(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _write_large(parts: DataFrame | Iterable[DataFrame], path: str, by: str | None = None) -> DataFrame:
    """The table that is written: one frame, or several one after the other."""
    for part in [parts] if isinstance(parts, DataFrame) else parts:
        spark, schema = part.sparkSession, part.schema
        writer = part.write.mode("append").option("compression", "zstd")
        with freed_shuffles(spark):
            (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage_large(
    parts: DataFrame | Iterable[DataFrame], name: str, spark: SparkSession | None = None
) -> DataFrame:
    """:func:`stage` for a table as large as the input: packed tighter, and its shuffle files go once it is written.

    ``parts`` is a frame, or frames of one schema that are made and written one after the other in ``spark``.
    """
    return _write_large(parts, _fresh(spark or parts.sparkSession, name))


@contextmanager
def staged_large(
    parts: DataFrame | Iterable[DataFrame], name: str, by: str | None = None, spark: SparkSession | None = None
) -> Iterator[DataFrame]:
    """A large stage table (in folders ``by`` a column, if named) that goes when the block ends: nothing may read it later."""
    spark = spark or parts.sparkSession
    path = _fresh(spark, name)
    try:
        yield _write_large(parts, path, by)
    finally:
        _delete(spark, path)


def drop_stages(df: DataFrame) -> None:
    """Delete the stage tables that a frame reads; it and what was made of it must not be read again."""
    root = stage_folder(df.sparkSession)
    own = f"/{root.rpartition('/')[2]}/"  # files are named with their store, the folder perhaps not
    for name in {f.partition(own)[2].split("/")[0] for f in df.inputFiles() if own in f}:
        _delete(df.sparkSession, f"{root}/{name}")


def drop_part(df: DataFrame, part: str) -> None:
    """Delete one partition folder of a stage table; its other rows can still be read."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if f"/{part}/" in f}:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete the stage tables of this application once nothing reads them."""
    _delete(spark, stage_folder(spark))
