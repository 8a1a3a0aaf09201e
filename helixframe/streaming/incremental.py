"""Structures that arrive in a folder: each new file is worked on once and its rows are appended to a table.

The file source remembers what it has read in the stream's checkpoint, so a restarted stream goes on where it was, and a
batch that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators.structure import best_atoms
from helixframe.sources.pdb import parse_atom_lines


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, value): the whole texts of files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def stream_atoms(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the atoms of PDB files; without state, as every file is whole in one batch."""
    texts = stream_texts(spark, folder, files_per_batch)
    lines = texts.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_number", "value"))
    return parse_atom_lines(lines)


def append_results(stream: DataFrame, function: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``function`` over each batch of a stream and write its rows under ``table``/batch=<number>.

    once: stop when all files that are there have been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        function(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def atom_counts(batch: DataFrame) -> DataFrame:
    """(path, chain_id, n_atoms) of a batch of atoms, repeated ones counted once."""
    one = batch.withColumn("model", F.lit(1))
    return best_atoms(one).groupBy("path", "chain_id").agg(F.count("*").alias("n_atoms"))
