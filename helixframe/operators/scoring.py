"""Comparison of models with targets by their torsions: circular statistics, tests and a score."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.circular import wrap

ANGLES = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "chi")
KEY = ("chain_id", "residue_number", "residue_name")
# Weights of the parts of the score, and the angles at which mean differences count as none.
FIT, CONCENTRATION, UNIFORMITY, COMPOSITE = (0.4, 0.6), (0.15, 0.3, 0.25, 0.3), (0.1, 0.2, 0.1, 0.2, 0.15, 0.25), (0.5, 0.2, 0.3)
UNSIGNED_NORM, SIGNED_NORM = math.pi / 2, math.pi / 4


def torsion_differences(target: DataFrame, models: DataFrame) -> DataFrame:
    """(path, angle, chain_id, residue_number, residue_name, signed): wrapped differences of target less model.

    Residues of the one target match those of each model (path) by chain, number and name; where a model repeats a key,
    its last residue counts. Angles that are null on a side give no row.
    """
    last = models.groupBy("path", *KEY).agg(F.max_by(F.struct(*ANGLES), "residue").alias("m"))
    one = target.select(*KEY, F.struct(*ANGLES).alias("t"), "residue")
    joined = one.join(last, list(KEY))
    angle = F.explode(F.array(*[F.struct(F.lit(a).alias("angle"), F.col(f"t.{a}").alias("a"), F.col(f"m.{a}").alias("b")) for a in ANGLES]))
    rows = joined.select("path", *KEY, angle.alias("d")).where("d.a is not null and d.b is not null and not isnan(d.a) and not isnan(d.b)")
    return rows.select("path", "d.angle", *KEY, wrap(F.col("d.a") - F.col("d.b")).alias("signed"))


def circular_mean(x: np.ndarray) -> float:
    return float(np.arctan2(np.sin(x).sum(), np.cos(x).sum()))


def resultant(x: np.ndarray) -> float:
    return float(np.hypot(np.sin(x).mean(), np.cos(x).mean()))


def circular_median(x: np.ndarray) -> float:
    """The angle of the data with the least sum of circular distances to all; of equals the circular mean."""
    x = np.asarray(x, float)
    values = np.unique(x)
    sums = np.concatenate([np.abs(np.angle(np.exp(1j * (values[k : k + 512, None] - x[None, :])))).sum(axis=1) for k in range(0, len(values), 512)])
    return circular_mean(values[sums <= sums.min() + 1e-9])


def circular_mad(x: np.ndarray, centre: float) -> float:
    return float(np.median(np.abs(np.angle(np.exp(1j * (np.asarray(x) - centre))))))


def bootstrap(x: np.ndarray, statistic: Callable[[np.ndarray], float], rounds: int, rng: np.random.Generator, alpha: float = 0.05) -> tuple[float, float]:
    """Percentile interval of a statistic over samples with replacement."""
    values = [statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(rounds)]
    return tuple(map(float, np.percentile(values, [100 * alpha / 2, 100 - 100 * alpha / 2])))


def concentration_test(n: int, observed: float, whole_circle: bool, rounds: int, rng: np.random.Generator) -> float:
    """Share of uniform samples of n angles whose median deviation is at most the observed one."""
    low = -math.pi if whole_circle else 0.0
    count = 0
    for _ in range(rounds):
        sample = rng.uniform(low, math.pi, n)
        count += circular_mad(sample, circular_median(sample)) <= observed
    return count / rounds


def rayleigh(x: np.ndarray) -> float:
    """p-value of uniformity against one preferred direction."""
    n = len(x)
    total = n * resultant(x)
    return float(min(1.0, math.exp(math.sqrt(1 + 4 * n + 4 * (n * n - total * total)) - (1 + 2 * n))))


def watson(x: np.ndarray) -> float:
    """p-value of Watson's U2 test of uniformity."""
    n = len(x)
    u = np.sort(np.mod(x, 2 * math.pi)) / (2 * math.pi)
    i = np.arange(1, n + 1)
    u2 = float(((u - (2 * i - 1) / (2 * n)) ** 2).sum() + 1 / (12 * n) - n * (u.mean() - 0.5) ** 2)
    u2 = (u2 - 0.1 / n + 0.1 / n**2) * (1 + 0.8 / n)
    m = np.arange(1, 51)
    return float(np.clip(2 * ((-1.0) ** (m - 1) * np.exp(-2 * (m * math.pi) ** 2 * max(u2, 0.0))).sum(), 0.0, 1.0)) if u2 > 0 else 1.0


def wilcoxon(x: np.ndarray) -> float:
    """Two-sided p-value of the signed-rank test: exact up to 50 values without ties and zeros, else by the normal law."""
    x = np.asarray(x, float)
    zeros = bool((x == 0).any())
    x = x[x != 0]
    n = len(x)
    if not n:
        return 1.0
    size, counts = np.unique(np.abs(x), return_inverse=True, return_counts=True)[1:]
    ends = np.cumsum(counts)
    ranks = (ends - (counts - 1) / 2)[size]
    plus = ranks[x > 0].sum()
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and not zeros and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(least) + 1].sum() / 2.0**n))
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - ((counts**3 - counts).sum()) / 2) / 24)
    return math.erfc(abs(least - n * (n + 1) / 4) / spread / math.sqrt(2))


STATISTICS = ("mcq", "mcd", "rmcq", "rmcd", "medcq", "medcd", "circular_mad_mcq", "circular_mad_mcd", "p_rayleigh_dmcd", "p_rayleigh_dmcq", "p_sim_test_dmcd", "p_sim_test_dmcq", "p_wilcoxon_dmcd", "p_watson_dmcd", "p_watson_dmcq")
INTERVALS = ("mcq", "mcd", "rmcq", "rmcd", "medcq", "medcd", "circular_mad_mcq", "circular_mad_mcd")


def statistics(signed: np.ndarray, rounds: int = 10_000, seed: int = 0) -> dict[str, float]:
    """Means (mcq of absolute, mcd of signed differences), resultants, medians, deviations, intervals and tests."""
    rng = np.random.default_rng(seed)
    sides = {"q": np.abs(signed), "d": signed}
    zero = bool(np.allclose(signed, 0))
    out: dict[str, float] = {}
    for k, x in sides.items():
        middle = 0.0 if zero else circular_median(x)
        out |= {f"mc{k}": circular_mean(x), f"rmc{k}": resultant(x), f"medc{k}": middle, f"circular_mad_mc{k}": circular_mad(x, middle)}
        functions = {f"mc{k}": circular_mean, f"rmc{k}": resultant, f"medc{k}": circular_median, f"circular_mad_mc{k}": lambda s, m=middle: circular_mad(s, m)}
        for name, function in functions.items():
            low, high = (0.0, 0.0) if zero and name in (f"mc{k}", f"medc{k}") else bootstrap(x, function, rounds, rng)
            out |= {f"ci_lower_{name}": low, f"ci_upper_{name}": high}
    doubled = 2 * sides["q"]
    out |= {"p_rayleigh_dmcd": rayleigh(signed), "p_rayleigh_dmcq": rayleigh(doubled)}
    out["p_sim_test_dmcd"] = concentration_test(len(signed), out["circular_mad_mcd"], True, rounds, rng)
    out["p_sim_test_dmcq"] = concentration_test(len(signed), out["circular_mad_mcq"], False, rounds, rng)
    out |= {"p_wilcoxon_dmcd": 0.0, "p_watson_dmcd": 0.0, "p_watson_dmcq": 0.0} if zero else {"p_wilcoxon_dmcd": wilcoxon(signed), "p_watson_dmcd": watson(signed), "p_watson_dmcq": watson(doubled)}
    return out


def score(m: Callable[[str], Column] = F.col) -> Column:
    """The composite score, 1 for equal structures, from columns named as in STATISTICS."""
    near = lambda value, norm: F.greatest(F.lit(0.0), 1 - value / norm)
    fit = FIT[0] * near(m("mcq"), UNSIGNED_NORM) + FIT[1] * near(m("medcq"), UNSIGNED_NORM)
    concentration = CONCENTRATION[0] * m("rmcq") + CONCENTRATION[1] * near(m("circular_mad_mcq"), 1.0) + CONCENTRATION[2] * (1 - m("p_watson_dmcq")) + CONCENTRATION[3] * (1 - m("p_sim_test_dmcq"))
    even = UNIFORMITY[0] * near(F.abs(m("mcd")), SIGNED_NORM) + UNIFORMITY[1] * near(F.abs(m("medcd")), SIGNED_NORM) + UNIFORMITY[2] * m("rmcd") + UNIFORMITY[3] * near(m("circular_mad_mcd"), SIGNED_NORM)
    even = even + UNIFORMITY[4] * (1 - m("p_rayleigh_dmcd")) + UNIFORMITY[5] * (1 - m("p_wilcoxon_dmcd"))
    return COMPOSITE[0] * fit + COMPOSITE[1] * concentration + COMPOSITE[2] * even


def evaluate(differences: DataFrame, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """(path, n, statistics, intervals, score) of each model from :func:`torsion_differences`; a model is one task's work.

    A model without a matched residue has no row.
    """
    names = [*STATISTICS, *(f"ci_{side}_{n}" for n in INTERVALS for side in ("lower", "upper"))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chain_id", "residue_number", "residue_name", "angle"])
        found = statistics(pdf["signed"].to_numpy(), rounds, seed)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "n": [len(pdf)], **{n: [found[n]] for n in names}})

    schema = "path string, n long, " + ", ".join(f"{n} double" for n in names)
    return differences.groupBy("path").applyInPandas(run, schema).withColumn("score", score())
