"""Session settings and durable intermediate tables.

Everything that must outlive a lost executor goes to the folder named by
``spark.checkpoint.dir``, which the cluster shares. A temporary folder is set
only where that setting is missing, as in local tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_cleaned: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weft")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints; one is made only if none is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = tempfile.mkdtemp(prefix="weft-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and reread it.

    For wide rows, where a columnar copy is smaller than a checkpoint. The
    folder goes when the application ends.
    """
    spark = df.sparkSession
    top = f"{checkpoint_root(spark)}/weft-{spark.sparkContext.applicationId}"
    path = f"{top}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_remove, spark, top)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have gone first
        return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
