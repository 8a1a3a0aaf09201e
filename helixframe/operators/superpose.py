"""Matched atoms of structure pairs and their RMSD by three methods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.chemistry import DEOXY_BACKBONE, PURINE_CORE, PYRIMIDINE_CORE, RIBOSE_BACKBONE, TEMPLATES
from helixframe.operators.structure import rmsd

PURINES, PYRIMIDINES = ("A", "G", "DA", "DG"), ("C", "U", "DC", "DT")


def matched_names(one: Column, two: Column) -> Column:
    """Names of the atoms that two residues are compared by: their template if the names are equal, else what purines or
    pyrimidines share, else the backbone; without O2' where a name begins with D, or where equal names have no template."""
    names = lambda x: F.array(*map(F.lit, x))
    templates = F.create_map(*[x for k, v in TEMPLATES.items() for x in (F.lit(k), names(v))])
    deoxy = one.startswith("D") | two.startswith("D")
    shared = lambda core: F.when(deoxy, names((*DEOXY_BACKBONE, *core))).otherwise(names((*RIBOSE_BACKBONE, *core)))
    equal = F.coalesce(F.try_element_at(templates, one), names(DEOXY_BACKBONE))
    return F.when(one == two, equal).when(one.isin(*PURINES) & two.isin(*PURINES), shared(PURINE_CORE)).when(one.isin(*PYRIMIDINES) & two.isin(*PYRIMIDINES), shared(PYRIMIDINE_CORE)).otherwise(shared(()))


def paired_coordinates(pairs: DataFrame, residues: DataFrame) -> DataFrame:
    """(a, b, p, q) of structure pairs (a, b): points of atoms with one name in residues at one place.

    ``residues``: id, place, residue_name, atoms (map of points). Places that one side lacks are left out.
    """
    one = residues.select(F.col("id").alias("a"), "place", F.col("residue_name").alias("_name_a"), F.col("atoms").alias("_a"))
    two = residues.select(F.col("id").alias("b"), "place", F.col("residue_name").alias("_name_b"), F.col("atoms").alias("_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, ["b", "place"]).withColumn("name", F.explode(matched_names(F.col("_name_a"), F.col("_name_b"))))
    points = both.select("a", "b", F.try_element_at("_a", F.col("name")).alias("p"), F.try_element_at("_b", F.col("name")).alias("q"))
    return points.where("p is not null and q is not null")


def rmsd_svd(p: np.ndarray, q: np.ndarray) -> float:
    """By the singular values of the covariance; a mirrored fit counts against the least one."""
    p, q = p - p.mean(axis=0), q - q.mean(axis=0)
    u, s, v = np.linalg.svd(p.T @ q)
    if np.linalg.det(u) * np.linalg.det(v) < 0:
        s[-1] = -s[-1]
    return float(np.sqrt(max(0.0, ((p * p).sum() + (q * q).sum() - 2 * s.sum()) / len(p))))


def rmsd_qcp(p: np.ndarray, q: np.ndarray) -> float:
    """By the largest root of the key matrix's characteristic polynomial, found by Newton's method from above."""
    p, q = p - p.mean(axis=0), q - q.mean(axis=0)
    m = p.T @ q
    size = ((p * p).sum() + (q * q).sum()) / 2
    if size == 0:
        return 0.0
    m, unit = m / size, 1.0
    axial = np.array([m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]])
    key = np.empty((4, 4))
    key[0, 0], key[0, 1:], key[1:, 0], key[1:, 1:] = np.trace(m), axial, axial, m + m.T - np.trace(m) * np.eye(3)
    c2, c1, c0 = -2 * (m * m).sum(), -8 * np.linalg.det(m), np.linalg.det(key)
    x = unit
    for _ in range(100):
        slope = 4 * x**3 + 2 * c2 * x + c1
        if slope == 0:
            break
        step = (x**4 + c2 * x * x + c1 * x + c0) / slope
        x -= step
        if abs(step) < 1e-14:
            break
    return float(np.sqrt(max(0.0, 2 * size * (1 - x) / len(p))))


METHODS = {"quaternions": rmsd, "svd": rmsd_svd, "qcp": rmsd_qcp}


def nrmsd(p: np.ndarray, q: np.ndarray, method: str = "quaternions", tolerance: float = 1e-6) -> float:
    """RMSD over the root of the number of points. validate: all methods, which must agree, else ValueError."""
    if method != "validate":
        return METHODS[method](p, q) / float(np.sqrt(len(p)))
    values = [f(p, q) / float(np.sqrt(len(p))) for f in METHODS.values()]
    if max(values) - min(values) > tolerance:
        raise ValueError(f"methods disagree: {dict(zip(METHODS, values))}")
    return values[0]


def nrmsd_of(points: DataFrame, method: str = "quaternions") -> DataFrame:
    """(a, b, n, d) of :func:`paired_coordinates`: one task's work per pair of structures."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = np.vstack(pdf["p"].to_numpy()), np.vstack(pdf["q"].to_numpy())
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "n": [len(p)], "d": [nrmsd(p, q, method)]})

    kind = dict(points.dtypes)["a"]
    return points.groupBy("a", "b").applyInPandas(run, f"a {kind}, b {kind}, n int, d double")


def pair_key(method: Column, *parts: Column) -> Column:
    """Key of a cached distance: md5 over what tells both files (path, time, size) and the method."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], method))


def not_cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the cache does not have."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")
