"""Session helpers shared by the operators: the shared folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own: list[str] = []


#: Rows of an Arrow batch: texts are long, and two tasks of an executor hold a few batches each.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, whatever their Python path is (once per application), and asks for small Arrow batches."""
    sc = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(batch)) > BATCH_ROWS:
        spark.conf.set(batch, BATCH_ROWS)
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)


def released() -> None:
    """Hands a worker's freed memory back: workers live on between tasks, and an executor has several."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one of our own only where the setting is absent (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_within(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; stops counting soon after."""
    return df.limit(most + 1).count() <= most


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", most: int = 2_000_000, width: int = 16) -> DataFrame:
    """Joins; broadcasts the right side only if it has at most 32 MB at the given width, else both sides are shuffled."""
    fits = rows_within(right, min(most, (32 << 20) // max(width, 1)))
    return left.join(F.broadcast(right) if fits else right, on, how)


#: Bytes of a side that may be broadcast.
BROADCAST = 64 << 20


def join_by_size(left: DataFrame, right: DataFrame, on: list[str], how: str, size: str) -> DataFrame:
    """Joins a written table; broadcasts it only if its bytes (an SQL expression for a row's) stay within BROADCAST."""
    total = right.agg(F.sum(F.expr(f"{size} + 40"))).first()[0] or 0
    return left.join(F.broadcast(right) if total <= BROADCAST else right, on, how)


def crc32_of_id(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary"))
