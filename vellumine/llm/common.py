"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a side that is broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 400_000

#: Rows of an Arrow batch: the default of ten thousand is too many for long texts, as a task holds a batch on both sides.
BATCH_ROWS = "1000"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()
_roots: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Give Python workers a copy of this package, so that they needn't have it installed, and small batches."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_KEY, "10000") == "10000":  # not set by the user
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    # Spark's file server hands the driver's file on to the executors
    target = os.path.join(tempfile.mkdtemp(prefix="vellumine-code-"), "vellumine.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def send_file(spark: SparkSession, path: str) -> str:
    """Hand a file of the driver to all executors; the name by which ``SparkFiles.get`` finds it there.

    Files of one application must differ in name.
    """
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shared_root(spark: SparkSession) -> str:
    """A fresh folder inside the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset and Spark runs
    on this machine alone (tests) a temporary folder takes its place.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(spark, "_vellumine_root", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="vellumine-")
            spark._vellumine_root = base
    root = f"{base.rstrip('/')}/vellumine-{uuid.uuid4().hex}"
    _roots.setdefault(spark.sparkContext.applicationId, []).append(root)
    return root


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders that ``shared_root`` gave out, from number ``since`` on.

    Results that are read from them must have been written elsewhere before.
    """
    roots = _roots.get(spark.sparkContext.applicationId, [])
    while len(roots) > since:
        remove(spark, roots.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the folders that operators made inside."""
    since = len(_roots.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)


def give_back() -> None:
    """Return memory that a Python task no longer needs to the system, as workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def materialise(df: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to ``path`` and read it back: lineage is cut there.

    packed: its large columns are compressed already, and Parquet leaves them as they are.  Else it would compress
    whole pages of them once more, in buffers as large as the largest page, which executors keep outside the heap.
    """
    writer = df.write.mode("overwrite")
    (writer.option("compression", "none") if packed else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that is no longer needed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_or_shuffled(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``side`` (cheap to read, best materialised) for broadcast only if it is small."""
    few = side.limit(rows + 1).count() <= rows
    return F.broadcast(side) if few else side.hint("merge")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
