"""Grouping of consecutive rows, de-duplication, votes and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], within: list[str], order: list[str], name: str = "run") -> DataFrame:
    """``df`` with the number (from 1) of the run of consecutive rows with equal ``keys``."""
    window = Window.partitionBy(*within).orderBy(*order)
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.lag(key).over(window))
    first = F.row_number().over(window) == 1
    return df.withColumn(name, F.sum(F.when(first | ~same, 1).otherwise(0)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def segments(df: DataFrame, breaks: Column, within: list[str], order: list[str], name: str = "segment") -> DataFrame:
    """``df`` with the number (from 1) of the segment; a row starts one where ``breaks`` holds. ``breaks`` may use lag."""
    window = Window.partitionBy(*within).orderBy(*order)
    start = F.when(F.row_number().over(window) == 1, 1).when(breaks, 1).otherwise(0)
    return df.withColumn("_start", start).withColumn(name, F.sum("_start").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def by_first_seen(df: DataFrame, value: str, order: str, within: list[str] | None = None, name: str = "code") -> DataFrame:
    """(within, value, code): values numbered from 1 by their first appearance.

    The numbering runs over one row per distinct value of a group: without ``within``, in one task.
    """
    within = within or []
    first = df.groupBy(*within, value).agg(F.min(order).alias("_first"))
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy("_first"))).drop("_first")


def most_common(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the most frequent value; among equals the one seen first."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return keep_first(counted, keys, [F.desc("n"), F.asc("_first")]).drop("_first")


def stem_runs(pairs: DataFrame, within: list[str]) -> DataFrame:
    """Maximal runs of pairs (i, j) with i rising and j falling by one: first i and j, and the length."""
    marked = pairs.withColumn("_s", F.col("i") + F.col("j"))
    marked = marked.withColumn("_r", F.col("i") - F.row_number().over(Window.partitionBy(*within, "_s").orderBy("i")))
    return marked.groupBy(*within, "_s", "_r").agg(F.min("i").alias("i"), F.max("j").alias("j"), F.count("*").alias("length")).drop("_s", "_r")


def crossing_pairs(intervals: DataFrame, within: list[str], id_col: str = "id") -> DataFrame:
    """(within, first, second): intervals (id, i, j) of a group that cross, i < k < j < l.

    Starts fall into bins as wide as intervals are on average, and an interval meets the starts in the bins that it
    covers, so a group is joined bin by bin. All intervals together cover at most about three bins each.
    """
    width = F.lit(max(1, int(intervals.agg(F.avg(F.col("j") - F.col("i"))).first()[0] or 1)))
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long")
    one = intervals.where("i < j").select(*within, F.col(id_col).alias("first"), F.col("i").alias("i1"), F.col("j").alias("j1"), F.explode(F.sequence(bin_of("i"), bin_of("j"))).alias("_bin"))
    two = intervals.where("i < j").select(*within, F.col(id_col).alias("second"), F.col("i").alias("i2"), F.col("j").alias("j2"), bin_of("i").alias("_bin"))
    return one.join(two, [*within, "_bin"]).where("i1 < i2 AND i2 < j1 AND j1 < j2").select(*within, "first", "second")


def merge_codes(codes: Column) -> Column:
    """Interaction codes of one pair: 3 and 5 become 4, 7 and 9 become 8, at the end; the first one is kept."""
    codes = F.array_sort(F.array_distinct(codes))
    for low, high, merged in ((3, 5, 4), (7, 9, 8)):
        both = F.array_contains(codes, low) & F.array_contains(codes, high)
        codes = F.when(both, F.concat(F.array_except(codes, F.array(F.lit(low), F.lit(high), F.lit(merged))), F.array(F.lit(merged)))).otherwise(codes)
    return F.get(codes, F.lit(0))
