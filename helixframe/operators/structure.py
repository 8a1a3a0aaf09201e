"""Operators on atom tables: residues, filters, contacts, segments, torsions, superposition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import geometry, residues
from helixframe.operators.groups import keep_first, runs, segments
from helixframe.operators.spatial import contact_join, radius_join
from helixframe.plans.components import connected_components

RESIDUE = ["chain_id", "residue_number", "insertion_code", "residue_name"]
#: Longest distance in angstrom of O3' and the next P in a chain: one and a half times 1.6.
LINK = 2.4
#: Up to so many atoms of a file are not dealt to cells.
FEW_ATOMS = 100
# Residue names of ions.
IONS = ("AG", "AL", "AU", "BA", "BR", "CA", "CD", "CL", "CO", "CS", "CU", "F", "FE", "HG", "I", "IOD", "K", "LI", "MG", "MN", "NA", "NI", "PB", "RB", "SR", "ZN")


def with_residues(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """``atoms`` with ``residue``, the number of the run of atoms with the same residue identity and model."""
    return runs(atoms, [*RESIDUE, "model"], ["path"], [order], "residue")


def best_atoms(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """One atom per residue, model and name: the highest occupancy, the first among equals."""
    return keep_first(atoms, ["path", "model", *RESIDUE, "atom_name"], [F.desc_nulls_last("occupancy"), F.asc(order)])


def select_model(atoms: DataFrame, model: int | None = None, order: str = "line_number") -> DataFrame:
    """Atoms of the asked model where a file has it, else of the model that its first atom has."""
    per_file = atoms.groupBy("path").agg(F.min_by("model", order).alias("_first"), F.max((F.col("model") == F.lit(model)).cast("int")).alias("_has"))
    chosen = F.when(F.col("_has") == 1, F.lit(model)).otherwise(F.col("_first"))
    return atoms.join(per_file, "path").where(F.col("model") == chosen).drop("_first", "_has")


def keep_polymers(atoms: DataFrame, *, nucleic: bool = True, protein: bool = False, water: bool = False, ions: bool = False, ligands: bool = False) -> DataFrame:
    """Atoms of the kinds of residues that are switched on; a residue's kind follows from its name and atoms."""
    name = F.col("residue_name")
    names = F.collect_set("atom_name").over(Window.partitionBy("path", "model", *RESIDUE))
    kind = (
        F.when(name.isin(*residues.WATER_NAMES), "water")
        .when(name.isin(*IONS), "ion")
        .when(name.isin(*residues.AMINO_ACIDS), "protein")
        .when(residues.molecule_class(name, names) != "Other", "nucleic")
        .otherwise("ligand")
    )
    wanted = [k for k, on in (("nucleic", nucleic), ("protein", protein), ("water", water), ("ion", ions), ("ligand", ligands)) if on]
    return atoms.withColumn("_kind", kind).where(F.col("_kind").isin(*wanted)).drop("_kind")


def _points(atoms: DataFrame, order: str) -> DataFrame:
    return atoms.withColumn("id", F.col(order).cast("long")).withColumn("p", geometry.point(F.col("x"), F.col("y"), F.col("z")))


def clashes(atoms: DataFrame, margin: float = 0.0, order: str = "line_number", *, any_occupancy: bool = True, same_residue: bool = False, same_name: bool = False) -> DataFrame:
    """(path, model, id_1, id_2, residue_1, residue_2, distance, occupancy): pairs of C, N, O and P atoms, by the first
    letters of their names, that are closer than their radii and the margin allow.

    Without ``any_occupancy`` only pairs whose occupancies (null or 0: 1) sum up to 1, as alternatives do. same_residue:
    also pairs within a residue. same_name: only atoms of one name. The margin that MolProbity allows for is 0.5.
    """
    points = with_residues(_points(atoms, order), order).withColumn("r", residues.atom_radius(F.col("atom_name"))).where("r is not null")
    points = points.withColumn("o", F.coalesce(F.nullif("occupancy", F.lit(0.0)), F.lit(1.0)))
    # Structures of few atoms are compared as they are.
    points = points.withColumn("_n", F.count("*").over(Window.partitionBy("path"))).withColumnRenamed("atom_name", "name")
    joined = contact_join(points, 2 * max(residues.RADII.values()) + margin, within=("path", "model"), carried=("r", "o", "residue", "name"), whole=F.col("_n") <= FEW_ATOMS)
    found = joined.withColumn("occupancy", F.col("o_1") + F.col("o_2")).where(F.col("distance") <= F.col("r_1") + F.col("r_2") + margin)
    if not any_occupancy:
        found = found.where(F.abs(F.col("occupancy") - 1) <= 1e-9 * F.greatest(F.col("occupancy"), F.lit(1.0)))
    if not same_residue:
        found = found.where("residue_1 <> residue_2")
    if same_name:
        found = found.where("name_1 = name_2")
    return found.select("path", "model", "id_1", "id_2", "residue_1", "residue_2", "name_1", "name_2", "distance", "occupancy")


#: Oxygens of a phosphate that a clash of O3' is named for.
PHOSPHATE_OXYGENS = ("OP1", "OP2", "OP3", "O1P", "O2P", "O3P")


def clash_rollup(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, occupancy): clashes per group of residues or chains, and the largest occupancy sum."""
    return found.groupBy(*keys).agg(F.count("*").alias("n"), F.max("occupancy").alias("occupancy"))


def clash_report(found: DataFrame, residues: DataFrame) -> DataFrame:
    """(path, model, level, chain_1, chain_2, residue_1, residue_2, name_1, name_2, occupancy): a row per chain pair, per
    residue pair and per atom pair of :func:`clashes`, each with its largest occupancy sum.

    ``residues`` (path, model, residue, chain_id) tells the chains. Columns below a row's level are null.
    """
    for k in (1, 2):
        names = residues.select("path", "model", F.col("residue").alias(f"residue_{k}"), F.col("chain_id").alias(f"chain_{k}")).distinct()
        found = found.join(names, ["path", "model", f"residue_{k}"])
    sets = [["path", "model", "chain_1", "chain_2"]]
    sets.append([*sets[0], "residue_1", "residue_2"])
    sets.append([*sets[1], "name_1", "name_2", "id_1", "id_2"])
    level = F.when(F.grouping("residue_1") == 1, "chains").when(F.grouping("id_1") == 1, "residues").otherwise("atoms")
    rolled = found.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[-1]]).agg(F.max("occupancy").alias("occupancy"), level.alias("level"))
    return rolled.select("path", "model", "level", "chain_1", "chain_2", "residue_1", "residue_2", "name_1", "name_2", "occupancy")


def clash_class(first: Column, second: Column) -> Column:
    """O3' for a clash of that atom with a phosphate oxygen, else null."""
    return F.when((first == "O3'") & second.isin(*PHOSPHATE_OXYGENS), F.lit("O3'"))


def drop_overlapping(atoms: DataFrame, radius: float = 0.5, order: str = "line_number") -> DataFrame:
    """Atoms without repeated ones and without those that lie within ``radius`` of one with higher occupancy.

    Of the atoms of a residue with one name the highest occupancy stays, the first among equals. Of two near atoms with
    equal occupancies the later one stays; where an occupancy is null, both stay.
    """
    points = _points(best_atoms(atoms, order), order)
    pairs = radius_join(points, radius, within=("path", "model"))
    sides = [points.select("path", "model", F.col("id").alias(f"id_{k}"), F.col("occupancy").alias(f"o_{k}")) for k in (1, 2)]
    joined = pairs.join(sides[0], ["path", "model", "id_1"]).join(sides[1], ["path", "model", "id_2"]).where("o_1 is not null and o_2 is not null")
    loser = F.when(F.col("o_1") > F.col("o_2"), F.col("id_2")).otherwise(F.col("id_1"))
    losers = joined.select("path", "model", loser.alias("id")).distinct()
    return points.join(losers, ["path", "model", "id"], "left_anti").drop("id", "p")


def by_chains(atoms: DataFrame, chains: list[str] | None = None, models: list[int] | None = None) -> DataFrame:
    """Atoms of the chains and models that are asked for; all for None."""
    if chains is not None:
        atoms = atoms.where(F.col("chain_id").isin(*chains))
    return atoms if models is None else atoms.where(F.col("model").isin(*models))


def nucleic_only(table: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Residues (path, entity, atoms) of nucleic acids: by the entity's kind where ``entities`` (path, entity, is_nucleic)
    has any for the file, else by their atoms."""
    from helixframe.functions.chemistry import is_nucleotide

    if entities is None:
        return table.where(is_nucleotide(F.col("atoms")))
    known = entities.groupBy("path", "entity").agg(F.max("is_nucleic").alias("_nucleic"))
    files = entities.select("path").distinct().withColumn("_listed", F.lit(True))
    marked = table.join(known, ["path", "entity"], "left").join(files, "path", "left")
    return marked.where(F.when(F.col("_listed"), F.coalesce("_nucleic", F.lit(False))).otherwise(is_nucleotide(F.col("atoms")))).drop("_nucleic", "_listed")


def anchors_of(atoms: DataFrame, name: str = "C1'", model: int | None = None) -> DataFrame:
    """The named atoms of one model (by default the least that has them), of chains with a plain nucleotide."""
    found = atoms.where(F.col("atom_name") == name)
    least = F.min("model").over(Window.partitionBy("path")) if model is None else F.lit(model)
    found = found.withColumn("_model", least).where(F.col("model") == F.col("_model")).drop("_model")
    plain = F.upper("residue_name").isin(*residues.RNA_NAMES, *residues.DNA_NAMES)
    return found.withColumn("_plain", F.max(plain.cast("int")).over(Window.partitionBy("path", "chain_id"))).where("_plain = 1").drop("_plain")


def chain_groups(atoms: DataFrame, radius: float = 15.0, order: str = "line_number") -> DataFrame:
    """(path, chain_id, group): chains whose C1' atoms come within ``radius`` are together; the group is its least chain.

    Looked at are the anchors of the first model and of chains with a plain nucleotide.
    """
    anchors = _points(anchors_of(atoms), order)
    pairs = radius_join(anchors, radius, within=("path",))
    sides = [anchors.select("path", F.col("id").alias(f"id_{k}"), F.col("chain_id").alias(f"chain_{k}")) for k in (1, 2)]
    links = pairs.join(sides[0], ["path", "id_1"]).join(sides[1], ["path", "id_2"]).where("chain_1 <> chain_2").select("path", "chain_1", "chain_2").distinct()
    numbered = anchors.select("path", "chain_id").distinct().withColumn("node", F.row_number().over(Window.partitionBy("path").orderBy("chain_id")) + F.pmod(F.hash("path"), F.lit(1 << 30)).cast("long") * 100_000)
    one, two = [numbered.select("path", F.col("chain_id").alias(f"chain_{k}"), F.col("node").alias(c)) for k, c in ((1, "a"), (2, "b"))]
    found = connected_components(links.join(one, ["path", "chain_1"]).join(two, ["path", "chain_2"]).select("a", "b")).withColumnRenamed("node", "n")
    rooted = numbered.join(found, numbered.node == found.n, "left").withColumn("root", F.coalesce("component", "node"))
    return rooted.withColumn("group", F.min("chain_id").over(Window.partitionBy("path", "root"))).select("path", "chain_id", "group")


def residue_table(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """One row per residue with a map from atom names to points."""
    marked = with_residues(_points(atoms, order), order)
    entries = F.map_from_entries(F.collect_list(F.struct("atom_name", "p")))
    return keep_first(marked, ["path", "model", "residue", "atom_name"], [F.asc(order)]).groupBy("path", "model", "residue", *RESIDUE).agg(entries.alias("atoms"))


def _atom(name: str) -> Column:
    return F.try_element_at("atoms", F.lit(name))


def with_segments(table: DataFrame) -> DataFrame:
    """Residues with the number of the stretch of residues that are bonded one after another."""
    window = Window.partitionBy("path", "model", "chain_id").orderBy("residue")
    gap = geometry.distance(F.lag(_atom("O3'")).over(window), _atom("P"))
    return segments(table, ~F.coalesce(gap < LINK, F.lit(False)), ["path", "model", "chain_id"], ["residue"])


def torsions(table: DataFrame) -> DataFrame:
    """Backbone and glycosidic torsions in radians of residues in segments; null where an atom is missing."""
    window = Window.partitionBy("path", "model", "chain_id", "segment").orderBy("residue")
    before, after = (lambda n: F.lag(_atom(n)).over(window)), (lambda n: F.lead(_atom(n)).over(window))
    purine = _atom("N9").isNotNull()
    four = {
        "alpha": (before("O3'"), _atom("P"), _atom("O5'"), _atom("C5'")),
        "beta": (_atom("P"), _atom("O5'"), _atom("C5'"), _atom("C4'")),
        "gamma": (_atom("O5'"), _atom("C5'"), _atom("C4'"), _atom("C3'")),
        "delta": (_atom("C5'"), _atom("C4'"), _atom("C3'"), _atom("O3'")),
        "epsilon": (_atom("C4'"), _atom("C3'"), _atom("O3'"), after("P")),
        "zeta": (_atom("C3'"), _atom("O3'"), after("P"), after("O5'")),
        "chi": (_atom("O4'"), _atom("C1'"), F.when(purine, _atom("N9")).otherwise(_atom("N1")), F.when(purine, _atom("C4")).otherwise(_atom("C2"))),
    }
    points = table.select("*", *[F.array(*p).alias(f"_{n}") for n, p in four.items()])

    def angle(n: str) -> Column:
        p = [F.col(f"_{n}")[k] for k in range(4)]
        whole = p[0].isNotNull() & p[1].isNotNull() & p[2].isNotNull() & p[3].isNotNull()
        return F.when(whole, geometry.torsion(*p)).alias(n)

    return points.select("path", "model", "residue", "segment", *RESIDUE, *[angle(n) for n in four])


def rmsd(p: np.ndarray, q: np.ndarray) -> float:
    """Least root-mean-square distance of two point sets under rotation and translation, by the quaternion matrix."""
    p, q = p - p.mean(axis=0), q - q.mean(axis=0)
    m = p.T @ q
    trace = np.trace(m)
    axial = np.array([m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]])
    key = np.empty((4, 4))
    key[0, 0], key[0, 1:], key[1:, 0], key[1:, 1:] = trace, axial, axial, m + m.T - trace * np.eye(3)
    best = np.linalg.eigvalsh(key)[-1]
    return float(np.sqrt(max(0.0, ((p * p).sum() + (q * q).sum() - 2 * best) / len(p))))


def nrmsd_pairs(paired: DataFrame) -> DataFrame:
    """(a, b, n, nrmsd) of (a, b, p, q): matched points of structure pairs; the RMSD over the root of their number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = np.vstack(pdf["p"].to_numpy()), np.vstack(pdf["q"].to_numpy())
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "n": [len(p)], "nrmsd": [rmsd(p, q) / np.sqrt(len(p))]})

    return paired.select("a", "b", "p", "q").groupBy("a", "b").applyInPandas(run, "a string, b string, n int, nrmsd double")


def pdb_documents(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """(path, content): PDB texts with MODEL, TER after each chain (with its last residue), ENDMDL and END.

    Atoms that do not fit a line are not written; :func:`fit_to_pdb` makes them fit.
    """
    from helixframe.sources import pdb

    c = F.col
    line = pdb.atom_line(record=c("record_type"), serial=c("serial"), name=c("atom_name"), alt=c("alt_loc"), residue=c("residue_name"), chain=c("chain_id"), number=c("residue_number"), icode=c("insertion_code"), x=c("x"), y=c("y"), z=c("z"), occupancy=F.coalesce(c("occupancy"), F.lit(1.0)), b=F.coalesce(c("b_factor"), F.lit(0.0)), element=c("element"), charge=c("charge"))
    window = Window.partitionBy("path").orderBy("model", order)
    last_chain = ~F.lead("chain_id").over(window).eqNullSafe(c("chain_id")) | ~F.lead("model").over(window).eqNullSafe(c("model"))
    ended = F.concat(F.lit("TER   "), pdb.wide_number(c("serial") + 1, 5), F.lit(" " * 6), F.lpad(c("residue_name"), 3, " "), F.lit(" "), F.lpad(c("chain_id"), 1, " "), pdb.wide_number(c("residue_number"), 4), F.coalesce(c("insertion_code"), F.lit("")))
    ter = F.rpad(F.coalesce(ended, F.lit("TER")), 80, " ")
    first_model = ~F.lag("model").over(window).eqNullSafe(c("model"))
    last_model = ~F.lead("model").over(window).eqNullSafe(c("model"))
    pieces = F.filter(F.array(F.when(first_model, F.concat(F.lit("MODEL     "), F.lpad(c("model").cast("string"), 4, " "))), line, F.when(last_chain, ter), F.when(last_model, F.lit("ENDMDL"))), lambda x: x.isNotNull())
    rows = atoms.select("path", "model", c(order).alias("o"), F.array_join(pieces, "\n").alias("text"))
    grouped = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("model", "o", "text"))).alias("rows"))
    return grouped.select("path", F.concat(F.array_join("rows.text", "\n"), F.lit("\nEND\n")).alias("content"))


#: What a PDB file can hold.
SERIALS, NUMBERS = 99_999, 9_999
CHAINS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def fits_pdb(atoms: DataFrame) -> DataFrame:
    """(path, fits): serials, chain names and residue numbers are within what PDB lines can hold."""
    good = (F.max("serial") <= SERIALS) & (F.max(F.length("chain_id")) <= 1) & (F.max("residue_number") <= NUMBERS)
    return atoms.groupBy("path").agg(F.coalesce(good, F.lit(True)).alias("fits"))


def fit_to_pdb(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """Chains as single letters and residues from 1 by first appearance, serials with a gap for each TER.

    Raises ValueError where a file has too many chains, residues in a chain, or atoms.
    """
    chains = atoms.groupBy("path", "chain_id").agg(F.min(order).alias("_first"))
    chains = chains.withColumn("_chain", F.row_number().over(Window.partitionBy("path").orderBy("_first"))).drop("_first")
    residue = ["path", "chain_id", "residue_number", "insertion_code", "residue_name"]
    first = F.min(order).over(Window.partitionBy(*[F.col(c) for c in residue]))
    numbered = atoms.join(chains, ["path", "chain_id"]).withColumn("_first", first)
    numbered = numbered.withColumn("_number", F.dense_rank().over(Window.partitionBy("path", "chain_id").orderBy("_first")))
    window = Window.partitionBy("path").orderBy("model", order)
    change = ~F.lag("chain_id").over(window).eqNullSafe(F.col("chain_id")) | ~F.lag("model").over(window).eqNullSafe(F.col("model"))
    numbered = numbered.withColumn("_change", change.cast("int")).withColumn("_row", F.row_number().over(window))
    serial = F.col("_row") + F.sum("_change").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = numbered.withColumn("_serial", serial)
    most = numbered.agg(F.max("_chain"), F.max("_number"), F.max("_serial")).first()
    for value, limit, what in zip(most, (len(CHAINS), NUMBERS, SERIALS), ("chains", "residues in a chain", "atoms")):
        if value is not None and value > limit:
            raise ValueError(f"{value} {what} do not fit into a PDB file of at most {limit}")
    changed = {"chain_id": F.substring(F.lit(CHAINS), F.col("_chain"), F.lit(1)), "residue_number": F.col("_number"), "insertion_code": F.lit(None).cast("string"), "serial": F.col("_serial").cast("int")}
    return numbered.withColumns(changed).select(*atoms.columns)
