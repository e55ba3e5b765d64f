"""What the operators ask of the session: a shared folder, splits and sizes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset in a local session, one in a temporary folder.

    On a cluster the folder must be one that the driver and all executors share, so there it has to be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = Path(tempfile.gettempdir(), "checkpoints").as_uri()
    return folder.rstrip("/")


#: Most bytes of one Arrow batch between the JVM and a Python worker; the default of 64 MB is paid several times over.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to ``BATCH_BYTES``, where it is higher.

    A row of more bytes still travels whole, alone in its batch.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """How many tables have been written so far, for ``discard``."""
    return len(_written)


def discard(since: int) -> None:
    """Delete the tables written since a ``mark``: call it when what was read from them is written itself."""
    while len(_written) > since:
        delete(*_written.pop())


def _remove() -> None:
    try:
        discard(0)
    except Exception:  # noqa: BLE001  the session has ended; the cluster's cleaner has the folder
        return


def doc_bucket(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; 0 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(buckets)), F.lit(0)).cast("int")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
