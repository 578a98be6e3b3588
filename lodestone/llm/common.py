"""What the operators share: the folder all executors see, and safe column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may fall back to a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made[path] = spark
    return path


def remove(path: str) -> None:
    spark = _made.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for path in list(_made):
        try:
            remove(path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, written once to the shared folder and read again, and their path for remove().

    Cuts the lineage and survives lost executors, as no copy sits on one machine.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """written_at() for tables that stay until the driver ends."""
    return written_at(df, name)[0]


def small_batches(spark: SparkSession, rows: int = 250) -> None:
    """Bound what one Arrow batch brings to a Python worker; the session keeps the setting.

    The JVM keeps direct buffers of the size of the largest batches beside its heap, and a worker what it took for them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
