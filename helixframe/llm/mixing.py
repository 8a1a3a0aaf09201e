"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights by filling up to a cap, each source gets a repetition
rate, and each document is emitted floor(rate) times plus one more copy if a number drawn from a seeded hash of its id
lies below the fraction. Only built-in functions: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.arrow import free_names
from helixframe.plans.storage import materialize

#: Source tables up to this many rows (some tens of bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the key and the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int) -> DataFrame:
    """One row per source: its size and target.

    ``sizes`` has source and source_size, one row per source. Sources in order of code points, null last, take the weights in turn.
    The total is ``share`` of all sizes. Sources whose target would pass ``cap`` times their size stop there and the
    excess goes to the others by weight; in order of size per weight, those that stop come first, so one pass with
    running sums finds the level. The windows run over one row per source, in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    rank = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("left", F.sum("source_size").over(everything) * share[0] - F.coalesce(F.sum("most").over(before), F.lit(0)) * share[1])
    w = w.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", F.col("left").cast("double") / F.lit(float(share[1])) / F.col("weight_left"))
    w = w.withColumn("open", F.col("most").cast("double") > F.col("level") * F.col("weight"))
    w = w.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("final") * F.col("weight")))
    return w.select("source", "source_size", target.alias("target"))


def mixing_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` with a struct column ``mix`` of size, source_size, target, rate and copies; every row stays.

    A null or blank text has size 0. A source without words has target and rate 0. A null source is a source of its own,
    last in the order. Rows with the same id draw the same number. A null id draws like an empty one. An input column
    called ``mix`` is replaced. An empty table gives an empty table.
    """
    (found,) = free_names(docs, "_mix_target")
    sized = docs.withColumn("mix", F.struct(word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source")))
    totals = sized.groupBy(F.col("mix.source").alias("source")).agg(F.sum("mix.size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, share, cap), "targets")
    targets = targets.select(F.struct(*targets.columns).alias(found))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("mix.source").eqNullSafe(F.col(f"{found}.source")), "left")
    target, total = F.col(f"{found}.target"), F.col(f"{found}.source_size")
    rate = F.when(total > 0, target / total).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(uniform(F.col(id_col), seed) < rate - whole, 1).otherwise(0)
    mix = F.struct(F.col("mix.size").alias("size"), total.alias("source_size"), target.alias("target"), rate.alias("rate"), copies.cast("long").alias("copies"))
    return joined.withColumn("mix", mix).drop(found)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as many times as :func:`mixing_plan` says, with the columns of ``docs``."""
    plan = mixing_plan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(docs, options)), **_KEYS, **{k: v for k, v in options.items() if k not in _KEYS})
    return plan.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int")))).select("row.*")


_KEYS = {"id_col": "doc_id", "text_col": "text", "source_col": "source"}


def _keys(docs: DataFrame, options: dict) -> list[Column]:
    return [F.col(f"`{options.get(k, name)}`").alias(name) for k, name in _KEYS.items()]
