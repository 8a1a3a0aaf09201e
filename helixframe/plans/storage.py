"""Intermediate tables in the shared folder of the cluster.

Lineage is cut by written Parquet tables only: they survive the loss of any executor, they carry no partitioning that
would hide an exchange from adaptive skew handling, and they are read back with column pruning.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of one Arrow batch, so that long rows do not fill a Python worker.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions that name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="helixframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


_made: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is deleted."""
    path = f"{shared_dir(spark)}/helixframe-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made[path] = spark
    return path


def _clear() -> None:
    for path, spark in _made.items():
        with contextlib.suppress(Exception):  # the session may be over by then
            delete_path(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._helixframe_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by :func:`materialize`; nothing may read it afterwards."""
    path = getattr(table, "_helixframe_path", None)
    if path:
        delete_path(table.sparkSession, path)
        _made.pop(path, None)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, whatever their Python path is."""
    context = spark.sparkContext
    for key, value in ARROW_BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if getattr(context, "_helixframe_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="helixframe-code-")
    target = os.path.join(folder, "helixframe_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(os.path.join(root, "helixframe")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file from there
    context._helixframe_shipped = True
