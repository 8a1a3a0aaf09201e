"""Base pairs and stacking from atoms: distributed radius joins, votes by edges, and a greedy choice per structure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import geometry
from helixframe.functions.residues import AMINO_ACIDS, WATER_NAMES
from helixframe.operators.spatial import radius_join
from helixframe.operators.structure import RESIDUE, with_residues

# Heavy atoms of the bases, donors, acceptors and the edges that each atom lies on.
BASE_ATOMS = {
    "A": ("N1", "C2", "N3", "C4", "C5", "C6", "N6", "N7", "C8", "N9"),
    "G": ("N1", "C2", "N2", "N3", "C4", "C5", "C6", "O6", "N7", "C8", "N9"),
    "C": ("N1", "C2", "O2", "N3", "C4", "N4", "C5", "C6"),
    "U": ("N1", "C2", "O2", "N3", "C4", "O4", "C5", "C6"),
    "T": ("N1", "C2", "O2", "N3", "C4", "O4", "C5", "C6", "C7"),
}
DONORS = {"A": ("C2", "N6", "C8", "O2'"), "G": ("N1", "N2", "C8", "O2'"), "C": ("N4", "C5", "C6", "O2'"), "U": ("N3", "C5", "C6", "O2'"), "T": ("N3", "C6", "C7")}
ACCEPTORS = {"A": ("N1", "N3", "N7"), "G": ("N3", "O6", "N7"), "C": ("O2", "N3"), "U": ("O2", "O4"), "T": ("O2", "O4")}
EDGES = {
    "A": {"N1": "W", "C2": "WS", "N3": "S", "N6": "WH", "N7": "H", "C8": "H", "O2'": "S"},
    "G": {"N1": "W", "N2": "WS", "N3": "S", "O6": "WH", "N7": "H", "C8": "H", "O2'": "S"},
    "C": {"O2": "WS", "N3": "W", "N4": "WH", "C5": "H", "C6": "H", "O2'": "S"},
    "U": {"O2": "WS", "N3": "W", "O4": "WH", "C5": "H", "C6": "H", "O2'": "S"},
    "T": {"O2": "WS", "N3": "W", "O4": "WH", "C6": "H", "C7": "H"},
}
#: Longest hydrogen bond; normals and the bond stand at 50 to 130 degrees. Stacked centroids, normals and offsets.
BOND, ACROSS = 4.0, (50.0, 130.0)
STACK, PARALLEL, ABOVE = 6.0, 35.0, 45.0


def _listed(lists: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The names that a table of tuples has for a key."""
    return F.try_element_at(F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), key)


def _table(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def letter_of_name(name: Column) -> Column:
    """The base of a residue name, null if it tells none: one letter, a letter after D, else a letter at the end."""
    letter = F.when(F.length(name) == 1, name).when(name.rlike("^[Dd].$"), F.substring(name, 2, 1)).otherwise(F.regexp_extract(name, "[A-Za-z]$", 0))
    return F.when(letter.isin(*BASE_ATOMS), letter)


def letter_of_atoms(names: Column) -> Column:
    """The base that has the largest part of its atoms among ``names``, the first of A, C, G, U, T at a tie, null if none."""
    parts = [(F.size(F.array_intersect(names, F.array(*map(F.lit, BASE_ATOMS[k])))) / len(BASE_ATOMS[k])).alias("part") for k in "ACGUT"]
    most = F.greatest(*parts)
    out = F.lit(None).cast("string")
    for k, part in reversed(list(zip("ACGUT", parts))):
        out = F.when(part == most, F.lit(k)).otherwise(out)
    return F.when(most > 0, out)


def bases(atoms: DataFrame, order: str = "line_number", standards: DataFrame | None = None) -> DataFrame:
    """One row per residue with a base: letter, centroid, normal and a map of its atoms; first atom of a name wins.

    The letter follows from ``standards`` (path, chain_id, residue_number, insertion_code, residue_name, standard_name),
    as read_modres and cif.standard_names give them, else from the name, else from the atoms. A residue whose name is not
    that of a plain nucleotide needs the atoms of the base's plane.
    """
    marked = with_residues(atoms, order).where(~F.coalesce(F.col("residue_name").isin(*WATER_NAMES, *AMINO_ACIDS), F.lit(False))).withColumn("p", geometry.point(F.col("x"), F.col("y"), F.col("z")))
    entry = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "atom_name", "p")))
    grouped = marked.groupBy("path", "model", "residue", "chain_id", "residue_number", "insertion_code", "residue_name").agg(entry.alias("e"))
    plain = F.col("residue_name").rlike("^D?[ACGUT]$")
    standard = F.lit(None).cast("string")
    if standards is not None:
        keys = ["path", *RESIDUE]
        given = standards.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("standard_name").alias("_standard"))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
        grouped = grouped.join(given, match, "left").drop(*[f"_{k}" for k in keys])
        standard = F.col("_standard")
    letter = F.coalesce(letter_of_name(standard), letter_of_name(F.col("residue_name")), letter_of_atoms(F.col("e.atom_name")))
    grouped = grouped.withColumn("letter", letter).where("letter is not null").drop("_standard")
    first = F.filter(F.col("e"), lambda x, k: ~F.exists(F.slice("e", 1, k), lambda y: y["atom_name"] == x["atom_name"]))
    grouped = grouped.withColumn("atoms", F.map_from_entries(F.transform(first, lambda x: F.struct(x["atom_name"], x["p"])))).drop("e")
    names = _listed(BASE_ATOMS, F.col("letter"))
    own = F.filter(F.transform(names, lambda n: F.try_element_at("atoms", n)), lambda p: p.isNotNull())
    grouped = grouped.withColumn("own", own).where(F.size("own") > 0)
    centroid = F.array(*[_mean("own", i) for i in range(3)])
    get = lambda n: F.try_element_at("atoms", F.lit(n))
    purine = F.col("letter").isin("A", "G")
    start = F.when(purine, get("N9")).otherwise(get("N1"))
    normal = geometry.base_normal(start, F.when(purine, get("N7")).otherwise(get("C4")), F.when(purine, get("N3")).otherwise(get("O2")))
    whole = start.isNotNull() & F.when(purine, get("N7").isNotNull() & get("N3").isNotNull()).otherwise(get("C4").isNotNull() & get("O2").isNotNull())
    grouped = grouped.where(plain | whole)
    return grouped.withColumn("centroid", centroid).withColumn("normal", F.when(whole, normal)).withColumn("glycosidic", start).drop("own")


def _mean(points: str, axis: int) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)


def _degrees(a: Column, b: Column) -> Column:
    return F.degrees(geometry.vector_angle(a, b))


def _acute(angle: Column) -> Column:
    return F.least(angle, 180 - angle)


def stackings(table: DataFrame) -> DataFrame:
    """(path, model, residue_1, residue_2, topology) of rows of :func:`bases`.

    Where a file has a residue before one of a lower chain, number or insertion code, the lower one is residue_1 and the
    topology is downward or outward, not upward or inward.
    """
    key = F.struct(F.coalesce("chain_id", F.lit("")).alias("chain"), "residue_number", F.coalesce("insertion_code", F.lit(" ")).alias("icode"))
    points = table.where("normal is not null").select("path", "model", F.col("residue").cast("long").alias("id"), F.col("centroid").alias("p"), "normal", key.alias("key"))
    pairs = radius_join(points, STACK, within=("path", "model"))
    sides = [points.select("path", "model", F.col("id").alias(f"id_{k}"), F.col("p").alias(f"p_{k}"), F.col("normal").alias(f"n_{k}"), F.col("key").alias(f"key_{k}")) for k in (1, 2)]
    joined = pairs.join(sides[0], ["path", "model", "id_1"]).join(sides[1], ["path", "model", "id_2"])
    between = _degrees(F.col("n_1"), F.col("n_2"))
    offset = geometry.minus(F.col("p_1"), F.col("p_2"))
    near = F.least(_degrees(offset, F.col("n_1")), _degrees(offset, F.col("n_2")))
    found = joined.where((_acute(between) <= PARALLEL) & (near <= ABOVE))
    same, inverted = geometry.dot(F.col("n_1"), F.col("n_2")) > 0, F.col("key_2") < F.col("key_1")
    topology = F.when(inverted, F.when(same, "downward").otherwise("outward")).otherwise(F.when(same, "upward").otherwise("inward"))
    one, two = F.when(inverted, F.col("id_2")).otherwise(F.col("id_1")), F.when(inverted, F.col("id_1")).otherwise(F.col("id_2"))
    return found.select("path", "model", one.alias("residue_1"), two.alias("residue_2"), topology.alias("topology"))


def base_pairs(table: DataFrame) -> DataFrame:
    """(path, model, residue_1, residue_2, lw, bonds): pairs of edges with at least two hydrogen bonds.

    Every bond votes for each combination of the edges of its atoms; votes are taken by falling count, and an edge of a
    residue serves once.
    """
    atoms = table.where("normal is not null").select("path", "model", "residue", "letter", "normal", "glycosidic", F.try_element_at("atoms", F.lit("C1'")).alias("c1"), F.explode("atoms").alias("atom", "p"))
    for name, source in (("donor", DONORS), ("acceptor", ACCEPTORS)):
        atoms = atoms.withColumn(name, F.array_contains(_listed(source, F.col("letter")), F.col("atom")))
    edge_key = F.concat("letter", F.lit(":"), "atom")
    edges = _table({f"{k}:{atom}": edges for k, v in EDGES.items() for atom, edges in v.items()})
    atoms = atoms.where("donor or acceptor").withColumn("edges", F.coalesce(F.try_element_at(edges, edge_key), F.lit(""))).where("edges <> ''")
    names = sorted({atom for v in EDGES.values() for atom in v})
    atoms = atoms.withColumn("id", F.col("residue").cast("long") * 64 + F.array_position(F.array(*map(F.lit, names)), F.col("atom")))
    pairs = radius_join(atoms.select("path", "model", "id", "p"), BOND, within=("path", "model"))
    keep = ["residue", "letter", "normal", "glycosidic", "c1", "p", "donor", "acceptor", "edges"]
    sides = [atoms.select("path", "model", *[F.col(c).alias(f"{c}_{k}") for c in ["id", *keep]]) for k in (1, 2)]
    bonds = pairs.join(sides[0], ["path", "model", "id_1"]).join(sides[1], ["path", "model", "id_2"])
    bonds = bonds.where("residue_1 <> residue_2 and ((donor_1 and acceptor_2) or (donor_2 and acceptor_1))")
    bond = geometry.minus(F.col("p_1"), F.col("p_2"))
    low, high = ACROSS
    for k in (1, 2):
        angle = _degrees(F.col(f"normal_{k}"), bond)
        bonds = bonds.where((angle > low) & (angle < high))
    turn = geometry.torsion(F.col("c1_1"), F.col("glycosidic_1"), F.col("glycosidic_2"), F.col("c1_2"))
    bonds = bonds.where("c1_1 is not null and c1_2 is not null").withColumn("side", geometry.cis_trans(turn))
    votes = bonds.select("path", "model", "residue_1", "residue_2", "side", "id_1", "id_2", F.explode(F.split("edges_1", "")).alias("e1"), "edges_2").withColumn("e2", F.explode(F.split("edges_2", ""))).where("e1 <> '' and e2 <> ''")
    counted = votes.groupBy("path", "model", "residue_1", "residue_2", "side", "e1", "e2").agg(F.count("*").alias("bonds"), F.min(F.struct("id_1", "id_2")).alias("first")).where("bonds >= 2")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(a=[f["id_1"] for f in pdf["first"]], b=[f["id_2"] for f in pdf["first"]]).sort_values(["bonds", "a", "b", "side", "e1", "e2"], ascending=[False, True, True, True, True, True])
        used: set = set()
        keep = []
        for r in pdf.itertuples(index=False):
            ends = {(r.residue_1, r.e1), (r.residue_2, r.e2)}
            keep.append(not ends & used)
            if keep[-1]:
                used |= ends
        pdf = pdf[keep]
        return pd.DataFrame({"path": pdf["path"], "model": pdf["model"], "residue_1": pdf["residue_1"], "residue_2": pdf["residue_2"], "lw": pdf["side"] + pdf["e1"] + pdf["e2"], "bonds": pdf["bonds"]})

    return counted.groupBy("path", "model").applyInPandas(choose, "path string, model int, residue_1 long, residue_2 long, lw string, bonds long")

