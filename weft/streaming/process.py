"""Micro-batch sinks: valid rows on, rejected rows aside, a batch's tables swapped in together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.ingest import quarantine


def publish_snapshot(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame]) -> None:
    """Write all tables of a version, then point to it: readers see all of them or, after a failure, none.

    The pointer is a file renamed into place after every table has been written,
    so a failing table leaves the version before in force.
    """
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/versions/{version}/{name}")
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    target, staged = hadoop.Path(f"{root}/pointers/{version}"), hadoop.Path(f"{root}/pointers/.{version}.new")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.create(staged, True).close()
    files.delete(target, False)
    if not files.rename(staged, target):
        raise OSError(f"could not point to version {version}")


def current_version(spark: SparkSession, root: str) -> str | None:
    """The last version that was written whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root}/pointers")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    names = sorted(n for n in (x.getPath().getName() for x in files.listStatus(folder)) if not n.startswith("."))
    return names[-1] if names else None


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}/{name}")


def split_stream(stream: DataFrame, good: str, bad: str, checkpoint: str, payload: str = "payload", extract: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write valid rows of each micro-batch to ``good`` after ``extract``, the rest to ``bad``.

    A batch whose extraction fails goes to ``bad`` whole, with the error and its
    type. A batch's folder is overwritten when the batch is run again, so a restart
    leaves each row once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        valid, rejected = quarantine(batch, payload)
        try:
            extract(valid).write.mode("overwrite").parquet(f"{good}/batch={number}")
        except Exception as problem:  # the rows are kept and the stream goes on
            told = {"error": F.lit(str(problem)[:500]), "error_type": F.lit(type(problem).__name__)}
            rejected = rejected.unionByName(valid.withColumns(told))
        rejected.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def persist_stream(stream: DataFrame, root: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]], interval: str | None = None) -> StreamingQuery:
    """Each micro-batch's nodes and edges (what ``tables`` makes of it) as one snapshot; polled each ``interval`` if given."""

    def sink(batch: DataFrame, number: int) -> None:
        publish_snapshot(batch.sparkSession, root, f"{number:012d}", tables(batch))

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
