"""Planes of bases, stacking and pair parameters, and hydrogen bonds by antecedent, donor and acceptor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import geometry
from helixframe.functions.chemistry import PURINE_CORE, PYRIMIDINE_CORE
from helixframe.functions.residues import in_ranges

# Three atoms that tell the face of a base, donors with their antecedents, acceptors, edges by atom.
FACE = {"purine": ("N9", "C4", "C5"), "pyrimidine": ("N1", "C6", "C5")}
DONORS = {
    "A": (("C6", "N6"), ("N1", "C2"), ("N7", "C8"), ("C2'", "O2'")),
    "G": (("C2", "N1"), ("C2", "N2"), ("N7", "C8"), ("C2'", "O2'")),
    "C": (("C4", "N4"), ("C4", "C5"), ("N1", "C6"), ("C2'", "O2'")),
    "U": (("C2", "N3"), ("C4", "C5"), ("N1", "C6"), ("C2'", "O2'")),
    "T": (("C2", "N3"), ("N1", "C6"), ("C5", "C7")),
}
ACCEPTORS = {"A": ("N1", "N3", "N7"), "G": ("N3", "O6", "N7"), "C": ("O2", "N3"), "U": ("O2", "O4"), "T": ("O2", "O4")}
BACKBONE_ACCEPTORS = ("OP1", "OP2", "O3'", "O5'", "O2'", "O4'")
EDGES = {
    "A": {"Watson-Crick": ("N1", "C2", "N6"), "Hoogsteen": ("N6", "N7", "C8"), "Sugar": ("C2", "N3", "O2'")},
    "G": {"Watson-Crick": ("N1", "N2", "O6"), "Hoogsteen": ("O6", "N7", "C8"), "Sugar": ("N2", "N3", "O2'")},
    "C": {"Watson-Crick": ("O2", "N4", "N3"), "Hoogsteen": ("N4", "C5", "C6"), "Sugar": ("O2", "O2'")},
    "U": {"Watson-Crick": ("O2", "N3", "O4"), "Hoogsteen": ("O4", "C5", "C6"), "Sugar": ("O2", "O2'")},
    "T": {"Watson-Crick": ("O2", "N3", "O4"), "Hoogsteen": ("O4", "C6", "C7"), "Sugar": ("O2",)},
}
#: Ranges of valid parameters, ends included; angles in degrees, lengths in angstrom.
THRESHOLDS = {
    "stacking": {"inter_planar": (3.0, 4.5), "dihedral": (0.0, 30.0), "lateral": (0.0, 3.0), "overlap": (5.0, 100.0)},
    "hbond": {"donor_acceptor": (2.5, 3.5), "angle": (100.0, 180.0)},
    "basepair": {"angle": (0.0, 30.0), "displacement": (0.0, 3.0)},
    "cis": {"torsion": (-30.0, 30.0)},
    "c1": {"c1_distance": (8.0, 15.0)},
}


def read_thresholds(text: str) -> dict[str, dict[str, tuple[float, float]]]:
    """Thresholds of an INI text with ``<name>_min`` and ``<name>_max`` per section."""
    import configparser

    parser = configparser.ConfigParser()
    parser.read_string(text)
    out: dict[str, dict[str, tuple[float, float]]] = {}
    for section in parser.sections():
        values = {k: float(v) for k, v in parser[section].items()}
        out[section] = {k[:-4]: (values[k], values[f"{k[:-4]}_max"]) for k in values if k.endswith("_min") and f"{k[:-4]}_max" in values}
    return out


def fit_planes(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and unit normals of the best-fit planes of point sets, all at once."""
    most = max(map(len, points))
    mask = np.zeros((len(points), most, 1))
    stacked = np.zeros((len(points), most, 3))
    for k, p in enumerate(points):
        mask[k, : len(p)], stacked[k, : len(p)] = 1, p
    centroids = stacked.sum(axis=1) / mask.sum(axis=1)
    gaps = (stacked - centroids[:, None, :]) * mask
    return centroids, np.linalg.eigh(np.einsum("kni,knj->kij", gaps, gaps))[1][:, :, 0]


def base_planes(table: DataFrame) -> DataFrame:
    """``table`` (letter, atoms: name to point) with core, centroid and normal of each base's ring atoms.

    The normal points to the side from which the face atoms turn right-handed; where one of them is missing its sign is
    arbitrary. Other letters and bases without a core atom are left out, those with fewer than three have no normal.
    """
    letter = F.upper("letter")
    core = lambda names: F.filter(F.array(*[F.try_element_at("atoms", F.lit(n)) for n in names]), lambda p: p.isNotNull())
    face = lambda names: F.array(*[F.try_element_at("atoms", F.lit(n)) for n in names])
    purine = letter.isin("A", "G")
    rows = table.where(letter.isin("A", "G", "C", "U", "T")).withColumn("core", F.when(purine, core(PURINE_CORE)).otherwise(core(PYRIMIDINE_CORE)))
    rows = rows.where(F.size("core") > 0).withColumn("_face", F.when(purine, face(FACE["purine"])).otherwise(face(FACE["pyrimidine"])))

    @F.pandas_udf("struct<centroid:array<double>,normal:array<double>>")
    def plane(cores: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in cores:
            centroids, normals = fit_planes([np.vstack(c) for c in batch]) if len(batch) else (np.zeros((0, 3)),) * 2
            yield pd.DataFrame({"centroid": list(centroids), "normal": [n if len(c) > 2 else None for n, c in zip(normals, batch)]})

    rows = rows.withColumn("_plane", plane("core"))
    f = F.col("_face")
    turned = geometry.cross(geometry.minus(f[1], f[0]), geometry.minus(f[2], f[0]))
    normal = F.col("_plane.normal")
    sign = F.when(geometry.dot(normal, turned) < 0, -1.0).otherwise(1.0)
    return rows.withColumn("centroid", F.col("_plane.centroid")).withColumn("normal", F.transform(normal, lambda x: x * sign)).drop("_face", "_plane")


def inter_planar_distance(c1: Column, n1: Column, c2: Column) -> Column:
    """Distance of a second centroid from the first plane."""
    return F.abs(geometry.dot(geometry.minus(c2, c1), n1))


def lateral_displacement(c1: Column, n1: Column, c2: Column) -> Column:
    """Distance of two centroids along the first plane."""
    gap = geometry.minus(c2, c1)
    up = geometry.dot(gap, n1)
    return geometry.norm(F.array(*[gap[i] - up * n1[i] for i in range(3)]))


def dihedral(n1: Column, n2: Column) -> Column:
    """Acute angle of two planes in degrees."""
    return F.degrees(F.acos(F.least(F.abs(geometry.dot(n1, n2)), F.lit(1.0))))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points of a plane, counter-clockwise."""
    rows = sorted(map(tuple, points))
    if len(rows) < 3:
        return np.array(rows)

    def half(items):
        out: list = []
        for p in items:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(rows) + half(reversed(rows)))


def clipped_area(one: np.ndarray, two: np.ndarray) -> float:
    """Area of the intersection of two convex polygons, counter-clockwise."""
    if len(one) < 3 or len(two) < 3:
        return 0.0
    left = list(one)
    for a, b in zip(two, np.roll(two, -1, axis=0)):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in left]
        kept = []
        for k, p in enumerate(left):
            last, before = left[k - 1], side[k - 1]
            if (side[k] >= 0) != (before >= 0):
                kept.append(last + (p - last) * (before / (before - side[k])))
            if side[k] >= 0:
                kept.append(p)
        left = kept
        if not left:
            return 0.0
    x, y = np.array(left).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def overlap_area(core_1: np.ndarray, normal: np.ndarray, centroid: np.ndarray, core_2: np.ndarray) -> float:
    """Area that the hulls of two bases share when both are seen along the first one's normal."""
    u = np.linalg.svd(normal[None, :])[2][1:]
    return clipped_area(hull((core_1 - centroid) @ u.T), hull((core_2 - centroid) @ u.T))


def stacking_parameters(pairs: DataFrame) -> DataFrame:
    """Pairs (core_k, centroid_k, normal_k) with inter_planar, dihedral, lateral, overlap, face and valid.

    face: Same where both bases turn the same side up, else Opposite. Valid pairs lie in the ranges; the overlap is only
    looked at where there is one.
    """

    @F.pandas_udf("double")
    def overlap(core_1: pd.Series, normal: pd.Series, centroid: pd.Series, core_2: pd.Series) -> pd.Series:
        return pd.Series([overlap_area(np.vstack(a), np.asarray(n), np.asarray(c), np.vstack(b)) for a, n, c, b in zip(core_1, normal, centroid, core_2)], dtype=float)

    c1, c2, n1, n2 = (F.col(c) for c in ("centroid_1", "centroid_2", "normal_1", "normal_2"))
    rows = pairs.where("normal_1 is not null and normal_2 is not null").withColumns({"inter_planar": inter_planar_distance(c1, n1, c2), "dihedral": dihedral(n1, n2), "lateral": lateral_displacement(c1, n1, c2), "overlap": overlap("core_1", "normal_1", "centroid_1", "core_2"), "face": F.when(geometry.dot(n1, n2) > 0, "Same").otherwise("Opposite")})
    ranges = dict(THRESHOLDS["stacking"])
    area = in_ranges({"overlap": ranges.pop("overlap")})
    return rows.withColumn("valid", in_ranges(ranges) & ((F.col("overlap") <= 0) | area))


def pair_parameters(pairs: DataFrame) -> DataFrame:
    """Pairs (centroid_k, normal_k, c1_k, glycosidic_k) with angle, displacement, torsion (degrees), c1_distance, valid, cis."""
    turn = F.degrees(geometry.torsion_flipped(F.col("c1_1"), F.col("glycosidic_1"), F.col("glycosidic_2"), F.col("c1_2")))
    rows = pairs.withColumns({"angle": dihedral(F.col("normal_1"), F.col("normal_2")), "displacement": inter_planar_distance(F.col("centroid_1"), F.col("normal_1"), F.col("centroid_2")), "torsion": turn, "c1_distance": geometry.distance(F.col("c1_1"), F.col("c1_2"))})
    return rows.withColumn("valid", in_ranges(THRESHOLDS["basepair"])).withColumn("cis", in_ranges(THRESHOLDS["cis"])).withColumn("c1_valid", in_ranges(THRESHOLDS["c1"]))


def coplanar(groups: DataFrame, keys: list[str], max_distance: float = 0.2, max_angle: float = 25.0) -> DataFrame:
    """(keys, coplanar) of groups of bases (core): centroids and normals lie near the plane through all ring atoms.

    A group is as large as a tetrad or a helix step. One base alone is coplanar; a base with fewer than three ring atoms
    gives null.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cores = [np.vstack(c) for c in pdf["core"]]
        if len(cores) < 2:
            flat = True
        elif min(map(len, cores)) < 3:
            flat = None
        else:
            centroids, normals = fit_planes(cores)
            centre, normal = (x[0] for x in fit_planes([np.vstack(cores)]))
            turn = np.degrees(np.arccos(np.clip(np.abs(normals @ normal), 0, 1)))
            flat = bool(np.abs((centroids - centre) @ normal).max() <= max_distance and turn.max() <= max_angle)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "coplanar": pd.Series([flat], dtype="object")})

    schema = ", ".join(f"`{k}` {t}" for k, t in groups.select(*keys).dtypes)
    return groups.select(*keys, "core").groupBy(*keys).applyInPandas(run, f"{schema}, coplanar boolean")


def donors_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, letter, antecedent, donor, a, d): donors that a residue (letter, atoms) has, with their antecedents."""
    listed = F.create_map(*[x for k, v in DONORS.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("antecedent"), F.lit(d).alias("donor")) for a, d in v]))])
    rows = table.select(*keys, "letter", "atoms", F.explode(F.try_element_at(listed, F.upper("letter"))).alias("w")).select(*keys, "letter", "w.*", F.try_element_at("atoms", F.col("w.antecedent")).alias("a"), F.try_element_at("atoms", F.col("w.donor")).alias("d"))
    return rows.where("a is not null and d is not null")


def acceptors_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, letter, acceptor, c): acceptors of base, phosphate and sugar that a residue has."""
    listed = F.create_map(*[x for k, v in ACCEPTORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    base = F.coalesce(F.try_element_at(listed, F.upper("letter")), F.array().cast("array<string>"))
    rows = table.select(*keys, "letter", "atoms", F.explode(F.array_distinct(F.concat(base, F.array(*map(F.lit, BACKBONE_ACCEPTORS))))).alias("acceptor"))
    return rows.select(*keys, "letter", "acceptor", F.try_element_at("atoms", F.col("acceptor")).alias("c")).where("c is not null")


def hbond_candidates(pairs: DataFrame, table: DataFrame, within: list[str]) -> DataFrame:
    """All donors of one with all acceptors of the other residue of given pairs (within, residue_1, residue_2), both ways.

    A pair of residues has at most some dozens. ``table``: within, residue, letter, atoms.
    """
    both = pairs.select(*within, F.col("residue_1").alias("gives"), F.col("residue_2").alias("takes")).unionByName(pairs.select(*within, F.col("residue_2").alias("gives"), F.col("residue_1").alias("takes")))
    donors = donors_of(table, [*within, "residue"]).withColumnsRenamed({"residue": "gives", "letter": "gives_letter"})
    acceptors = acceptors_of(table, [*within, "residue"]).withColumnsRenamed({"residue": "takes", "letter": "takes_letter"})
    return both.join(donors, [*within, "gives"]).join(acceptors, [*within, "takes"])


def hbond_parameters(candidates: DataFrame) -> DataFrame:
    """Candidates (points a, d, c) with antecedent_donor, donor_acceptor, angle (degrees) and valid."""
    a, d, c = F.col("a"), F.col("d"), F.col("c")
    rows = candidates.withColumns({"antecedent_donor": geometry.distance(a, d), "donor_acceptor": geometry.distance(d, c), "angle": F.degrees(geometry.vector_angle(geometry.minus(a, d), geometry.minus(c, d)))})
    return rows.withColumn("valid", F.coalesce(in_ranges(THRESHOLDS["hbond"]), F.lit(False)))


def edges_of(letter: Column, atom: Column) -> Column:
    """Edges that an atom of a base lies on."""
    keys: dict[str, list[str]] = {}
    for base, edges in EDGES.items():
        for edge, atoms in edges.items():
            for name in atoms:
                keys.setdefault(f"{base} {name}", []).append(edge)
    listed = F.create_map(*[x for k, v in keys.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(listed, F.concat(F.upper(letter), F.lit(" "), atom)), F.array().cast("array<string>"))


def edge_counts(bonds: DataFrame, within: list[str]) -> DataFrame:
    """(within, residue, edge, n): how often valid bonds use each edge of a residue."""
    valid = bonds.where("valid")
    gives = valid.select(*within, F.col("gives").alias("residue"), F.explode(edges_of(F.col("gives_letter"), F.col("donor"))).alias("edge"))
    takes = valid.select(*within, F.col("takes").alias("residue"), F.explode(edges_of(F.col("takes_letter"), F.col("acceptor"))).alias("edge"))
    return gives.unionByName(takes).groupBy(*within, "residue", "edge").agg(F.count("*").alias("n"))
