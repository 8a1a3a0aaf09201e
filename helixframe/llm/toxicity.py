"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, whose labels are not looked at, are the unlabelled ones. A linear
classifier in numpy over the words of a text is trained on the risk

    prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

whose second part must not fall below zero: where it does, the step goes up that part instead. The loss is the sigmoid
one: it is bounded, so a prior that is too high does not drive all scores up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.arrow import add_columns, slices, trim
from helixframe.llm.words import word_hashes
from helixframe.plans.storage import discard, materialize

BITS = 20


@dataclass(frozen=True)
class Settings:
    """positives, unlabelled: bounds of the training sample, taken in order of a hash of the id.

    features, apart: hashed words kept, those whose shares of texts differ most and by so many standard errors; the share
    of unlabelled texts is that of all documents that training may use. prior: share of toxic texts; None: that of the
    labelled training rows.
    """

    positives: int = 4000
    unlabelled: int = 12000
    features: int = 2048
    apart: float = 4.5
    rounds: int = 800
    rate: float = 0.1
    decay: float = 3e-6
    prior: float | None = None
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """Weights of the chosen hashed words."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float

    def scorer(self):
        """A function from texts to scores between 0 and 1."""
        dense = np.zeros(1 << BITS)
        dense[self.words] = self.weights
        known = dense != 0

        def score(texts: list[str | None]) -> np.ndarray:
            hashes, counts = word_hashes(texts, plain=True)
            words = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
            at = np.flatnonzero(known[words])
            rows = np.repeat(np.arange(len(counts)), counts)[at]
            both = np.unique(rows << BITS | words[at])
            return 1 / (1 + np.exp(-(np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], len(texts)) + self.bias)))

        return score


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed word of each distinct word of each text."""
    hashes, counts = word_hashes(texts, plain=True)
    rows = np.repeat(np.arange(len(counts)), counts)
    both = np.unique(rows.astype(np.uint64) << np.uint64(BITS) | hashes >> np.uint64(64 - BITS))
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def choose(positive: np.ndarray, n_p: int, unlabelled: np.ndarray, n_u: int, settings: Settings = Settings()) -> np.ndarray:
    """The hashed words to learn weights for, from the numbers of texts that hold each word."""
    if not n_p or not n_u:
        return np.zeros(0, np.int64)
    pooled = (positive + unlabelled) / (n_p + n_u)
    apart = np.abs(positive / n_p - unlabelled / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-9)
    chosen = np.argsort(-apart, kind="stable")[: settings.features]
    return chosen[(positive + unlabelled > 1)[chosen] & (apart[chosen] >= settings.apart)]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, settings: Settings = Settings(), chosen: np.ndarray | None = None) -> Model:
    """positive, unlabelled: the hashed words of each text. Without positives all scores are near the prior's floor."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.int64), np.zeros(0), -5.0, settings.threshold)
    n_p, n_u = len(positive), len(unlabelled)
    if chosen is None:
        chosen = choose(*(f(x) for x in (positive, unlabelled) for f in (lambda x: np.bincount(np.concatenate(x), minlength=1 << BITS), len)), settings)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    texts = [*positive, *unlabelled]
    rows = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    columns = place[np.concatenate(texts)]
    rows, columns = rows[columns >= 0], columns[columns >= 0]
    w, b = np.zeros(len(chosen)), -2.0
    moments = np.zeros((2, len(chosen) + 1))
    is_p = np.arange(len(texts)) < n_p
    for step in range(1, settings.rounds + 1):
        margin = np.bincount(rows, w[columns], len(texts)) + b
        chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        rest = chance[~is_p].mean() - prior * chance[is_p].mean()
        change = chance * (1 - chance)
        slope = np.where(is_p, -prior / n_p, 1 / n_u) * change  # of the second part
        if rest < 0:
            slope = -slope
        else:
            slope = slope - np.where(is_p, prior / n_p, 0.0) * change
        gradient = np.append(np.bincount(columns, slope[rows], len(chosen)) + settings.decay * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        change = settings.rate * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    return Model(chosen, w, float(b), settings.threshold)


def held_out(doc_id: Column) -> Column:
    """Rows that no training may use: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``positives`` toxic rows of ``labels`` (doc_id, toxic) and ``unlabelled`` rows of ``docs``.

    Held-out rows are never used. The rows are the first ones in order of a hash of their ids, so reruns agree; of rows
    with equal ids one counts. Words are chosen by the sample's toxic texts and by all documents that are not held out,
    whose word counts (a table of fixed size) are added up. Only ids are sorted for the sample; its texts are written, and
    what goes to the driver is the chosen words of each, at most ``features``. Null labels and ids take no part; without
    positives nothing is scored toxic.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    prior = settings.prior
    if prior is None:
        prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.1
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.positives)
    others = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.unlabelled)
    ids = toxic.select("doc_id", F.lit(1).alias("p")).unionByName(others.select("doc_id", F.lit(0).alias("p")))
    ids = ids.groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))  # at most as many rows as the settings say
    chosen_docs = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "p", "u").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = materialize(chosen_docs, "training")

    def word_counts(table: DataFrame) -> tuple[np.ndarray, int]:
        """How many texts hold each hashed word, and the number of texts."""

        def run(batches):
            counts = np.zeros((1 << BITS) + 1, np.int64)
            for batch in batches:
                for texts in slices(batch.column(0).to_pylist()):
                    counts[:-1] += np.bincount(features(texts)[1], minlength=1 << BITS)
                    counts[-1] += len(texts)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["word", "n"])
            trim()

        rows = table.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((1 << BITS) + 1, np.int64)
        counts[np.asarray(rows.column("word"))] = np.asarray(rows.column("n"))
        return counts[:-1], int(counts[-1])

    chosen = choose(*word_counts(sample.where("p = 1")), *word_counts(docs), settings)
    is_chosen = np.zeros(1 << BITS, bool)
    is_chosen[chosen] = True

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, words = features(part.column(3).to_pylist())
                kept = is_chosen[words]
                rows, words = rows[kept], words[kept]
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=part.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(words.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["doc_id", "p", "u", "words"])
        trim()

    rows = sample.select("doc_id", "p", "u", "text").mapInArrow(run, "doc_id long, p int, u int, words array<int>").toArrow().sort_by("doc_id")
    discard(sample)
    words = [np.asarray(x.values) for x in rows.column("words")]
    is_p, is_u = rows.column("p").to_pylist(), rows.column("u").to_pylist()
    return train([w for w, p in zip(words, is_p) if p == 1], [w for w, u in zip(words, is_u) if u == 0], min(max(prior, 1e-3), 0.9), settings, chosen)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1: toxic) of each whole text; one output row per input row.

    A null or empty text scores by the bias alone. Input columns of these names are replaced. An empty table gives an
    empty table. The model, of fixed size, travels with the task.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: int):
        scorer, threshold = shared.value.scorer(), shared.value.threshold

        def run(batch: pa.RecordBatch) -> list:
            scores = np.concatenate([np.zeros(0), *map(scorer, slices(batch.column(column).to_pylist()))])
            return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

        return run

    return add_columns(docs, "score double, predicted int", compute, at)
