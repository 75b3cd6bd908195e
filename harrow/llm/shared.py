"""Session helpers: the shared folder, shipping the package to executors, sizing partitions."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if "local" not in _LOCAL:
        _LOCAL["local"] = tempfile.mkdtemp(prefix="harrow-")
        atexit.register(shutil.rmtree, _LOCAL["local"], ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + _LOCAL["local"])
    return "file://" + _LOCAL["local"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Rows of a few numbers that a task writes as one file where there are not enough for all cores.
ROWS_EACH = 25_000


def written(df: DataFrame, name: str, *partition_by: str, narrow: bool = False, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    narrow: rows of a few numbers, of which a task can write many: fewer files, but four for each core.
    rows: the same for rows at most so many, where that is known; then a file for each ``ROWS_EACH`` is enough.
    """
    spark = df.sparkSession
    if narrow or rows is not None:
        most = max(4 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 8)
        df = df.coalesce(most if rows is None else min(most, 1 + rows // ROWS_EACH))
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() returned, once nothing reads it any more."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: What modules keep in a worker from one task to the next, by the module's name.
_KEPT: dict[str, dict] = {}


def keeps(name: str, held: dict) -> None:
    """Says that a module keeps what is in held between tasks."""
    _KEPT[name] = held


def let_go(but: str | None = None) -> None:
    """Drops what this process keeps between tasks, except what the module named keeps."""
    dropped = [held.clear() for name, held in _KEPT.items() if name != but and held]
    if dropped:
        gc.collect()  # what is held may refer to itself


def give_back() -> None:
    """Gives memory that is not used any more back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slim(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeper: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before which a worker drops what other modules than keeper keep there, and after which it gives memory that
    it no longer uses back to the system."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeper)  # workers live on from stage to stage, and a store is of no use to another one's tasks
        give_back()  # so that it does not stand beside what the task needs
        yield from run(batches)
        give_back()

    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that no path has to be set there."""
    sc = spark.sparkContext
    if _LOCAL.get("shipped") == sc.applicationId:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in sorted(os.walk(top)):
            for file in sorted(files):
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    folder = tempfile.mkdtemp(prefix="harrow-ship-")
    path = os.path.join(folder, f"{name}.zip")
    with open(path, "wb") as out:
        out.write(buffer.getvalue())
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _LOCAL["shipped"] = sc.applicationId


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
