"""Secondary-structure text: FASTA, BPSEQ and dot-bracket files as DataFrames, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.pdb import scan_lines


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def normalised(sequence: Column) -> Column:
    """Upper case, with U for T."""
    return F.translate(F.upper(sequence), "T", "U")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, sequence); sequences in upper case with U for T."""
    records = _whole(spark, path).select("path", F.posexplode(F.split("value", "(?m)^>")).alias("record", "value")).where("record > 0")
    header = F.trim(F.regexp_extract("value", "^([^\r\n]*)", 1))
    sequence = normalised(F.regexp_replace(F.regexp_replace("value", "^[^\r\n]*", ""), r"\s+", ""))
    return records.select("path", "record", header.alias("header"), sequence.alias("sequence"))


def read_bpseq(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, base, pair) of lines with three columns; other lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = scan_lines(spark, path).withColumn("parts", parts).where(F.size("parts") == 3)
    rows = rows.select("path", F.get("parts", F.lit(0)).try_cast("int").alias("i"), F.get("parts", F.lit(1)).alias("base"), F.get("parts", F.lit(2)).try_cast("int").alias("pair"))
    return rows.where("i is not null and pair is not null")


def read_dot_bracket(spark: SparkSession, path: str) -> DataFrame:
    """(path, strand, header, sequence, structure, first): strands of files of two-line or headed three-line records.

    ``first`` is the index (from 1) of the strand's first residue in the file.
    """
    lines = F.filter(F.transform(F.split("value", "\r?\n"), F.trim), lambda x: x != "")
    plain = F.filter(lines, lambda x: ~x.startswith(">"))
    heads = F.filter(lines, lambda x: x.startswith(">"))
    files = _whole(spark, path).select("path", plain.alias("plain"), heads.alias("heads"))
    strands = files.select("path", "plain", "heads", F.explode(F.sequence(F.lit(0), F.floor(F.size("plain") / 2).cast("int") - 1)).alias("strand"))
    before = F.aggregate(F.slice("plain", 1, F.col("strand") * 2), F.lit(0), lambda n, x: n + F.length(x)) / 2
    return strands.select("path", "strand", F.get("heads", F.col("strand")).alias("header"), F.get("plain", F.col("strand") * 2).alias("sequence"), F.get("plain", F.col("strand") * 2 + 1).alias("structure"), (before + 1).cast("int").alias("first"))


def bpseq_line(i: Column, base: Column, pair: Column) -> Column:
    return F.concat_ws(" ", i.cast("string"), base, pair.cast("string"))
