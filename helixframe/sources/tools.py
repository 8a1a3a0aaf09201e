"""Outputs of RNAView, Barnaba, MC-Annotate and DNATCO as interactions, in the schema of :mod:`annotations`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import geometry
from helixframe.functions.chemistry import lookup
from helixframe.sources.annotations import ROMAN, lw_text, unified
from helixframe.sources.pdb import scan_lines

# RNAView's marks of contacts, Barnaba's of stacking, MC-Annotate's of edges and backbone atoms.
RNAVIEW_KINDS = {"!(b_s)": "base-ribose", "!b_(O1P,O2P)": "base-phosphate", "!(s_s)": "other", "!1H(b_b)": "other"}
BARNABA_STACKS = {">>": "upward", "<<": "downward", "<>": "outward", "><": "inward"}
MC_EDGES = {"Hh": "H", "Hw": "H", "Bh": "H", "C8": "H", "Wh": "W", "Ww": "W", "Ws": "W", "Ss": "S", "Sw": "S", "Bs": "S"}
MC_RIBOSE, MC_PHOSPHATE = "O2'", "O2P"
MC_SECTIONS = {"Residue conformations": "residues", "Adjacent stackings": "adjacent", "Non-Adjacent stackings": "stackings", "Base-pairs": "pairs", "Number of": "summary"}
TOPOLOGIES = ("upward", "downward", "inward", "outward")
#: A line of RNAView's pairs: indices, chain, number and names of both residues, then stacked or edges and a class.
RNAVIEW_LINE = r"^\s*(\d+)_(\d+),\s+(\S):\s+(-?\d+)\s+(\w+)-(\w+)\s+(-?\d+)\s+(\S):\s+(?:syn\s+)*(?:(\S/\S)\s+(cis|tran)\s*(?:syn\s+)*(\S.*?)|(stacked))\.?\s*$"


def _real(value: Column) -> Column:
    return F.when(~F.trim(value).isin("", "?", "."), value)


def rnaview_indices(residues: DataFrame) -> DataFrame:
    """(path, index, chain_id, residue_number, insertion_code, residue_name): RNAView's numbers (from 1) of residues.

    It counts residues (in order of ``residue``, with ``atoms``) whose ring closes: N1-C2 and N1-C6 within 2 angstrom, C2-C6
    within 3.
    """
    at = lambda n: F.try_element_at("atoms", F.lit(n))
    closed = (geometry.distance(at("N1"), at("C2")) <= 2) & (geometry.distance(at("N1"), at("C6")) <= 2) & (geometry.distance(at("C2"), at("C6")) <= 3)
    number = F.row_number().over(Window.partitionBy("path").orderBy("residue"))
    return residues.where(F.coalesce(closed, F.lit(False))).withColumn("index", number).select("path", "index", "chain_id", "residue_number", "insertion_code", "residue_name")


def parse_rnaview(lines: DataFrame, indices: DataFrame | None = None) -> DataFrame:
    """Interactions of (path, line_number, value); residues by RNAView's index where ``indices`` (of one structure) are given."""
    v = F.col("value")
    mark = F.when(v.startswith("BEGIN_base-pair"), True).when(v.startswith("END_base-pair"), False)
    # One match gives all groups, the free text last; a line that does not match is left as it is.
    fields = F.regexp_replace(v, RNAVIEW_LINE, "\u0001".join(f"${i}" for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 11)))
    kept = lines.select("path", "line_number", mark.alias("_mark"), F.split(F.nullif(fields, v), "\u0001", 12).alias("f"))
    window = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    inside = kept.withColumn("_in", F.last("_mark", ignorenulls=True).over(window)).where("_in and f is not null")
    group = lambda i: F.col("f")[{11: 11, 12: 10}.get(i, i - 1)]
    rows = inside.select("path", group(1).cast("int").alias("index_1"), group(2).cast("int").alias("index_2"), _real(group(3)).alias("chain_1"), group(4).cast("int").alias("number_1"), group(5).alias("name_1"), group(6).alias("name_2"), group(7).cast("int").alias("number_2"), _real(group(8)).alias("chain_2"), group(9).alias("edges"), group(10).alias("side"), F.trim(group(11)).alias("token"), group(12).alias("stacked"))
    letters = F.when(F.col("edges").isin("+/+", "-/-", "X/X"), "WW").otherwise(F.upper(F.translate("edges", "/", "")))
    roman = F.split("token", ",")[0]
    lw = F.when((F.col("token") == "n/a") | F.col("token").rlike("^[IVX]+$") | F.col("token").isin("XIV,XV", "XII,XIII"), lw_text(F.concat(F.substring("side", 1, 1), letters)))
    kind = F.when(F.col("stacked") != "", "stacking").when(lw.isNotNull(), "base-pair").otherwise(F.coalesce(lookup(F.col("token"), RNAVIEW_KINDS), F.when((F.col("token") == "n/a") | F.col("token").rlike("^[IVX,]+$"), F.lit("other"))))
    rows = rows.withColumns({"kind": kind, "lw": lw, "saenger": F.when(lw.isNotNull() & roman.isin(*ROMAN), roman), "code": F.when(F.col("stacked") != "", F.col("stacked")).otherwise(F.concat_ws(" ", "edges", "side", "token"))}).where("kind is not null")
    if indices is not None:
        for k in (1, 2):
            known = indices.select(F.col("index").alias(f"index_{k}"), F.col("chain_id").alias(f"chain_{k}"), F.col("residue_number").alias(f"number_{k}"), F.col("insertion_code").alias(f"icode_{k}"), F.col("residue_name").alias(f"name_{k}"))
            rows = rows.drop(f"chain_{k}", f"number_{k}", f"name_{k}").join(known, f"index_{k}")
    return unified(rows, "rnaview")


def read_rnaview(spark: SparkSession, path: str, indices: DataFrame | None = None) -> DataFrame:
    return parse_rnaview(scan_lines(spark, path), indices)


def parse_mc_annotate(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Interactions of (path, line_number, value). ``names``: chain_id, residue_number, insertion_code, residue_name."""
    v = F.col("value")
    window = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    head = F.lit(None).cast("string")
    for start, section in MC_SECTIONS.items():
        head = F.when(v.startswith(start), section).otherwise(head)
    rows = lines.withColumn("_head", head).withColumn("section", F.last("_head", ignorenulls=True).over(window)).where("_head is null and section in ('adjacent', 'stackings', 'pairs')")
    unit = r"^'?(.)'?(-?[0-9]+)\.?([a-zA-Z]?)-'?(.)'?(-?[0-9]+)\.?([a-zA-Z]?)"
    first = F.split(F.trim(v), r"\s+")
    rows = rows.withColumn("f", first).where(F.col("f")[0].rlike(unit))
    part = lambda i: F.regexp_extract(F.col("f")[0], unit, i)
    rows = rows.select("path", "section", "f", *[c for k in (1, 2) for c in (part(3 * k - 2).alias(f"chain_{k}"), part(3 * k - 1).cast("int").alias(f"number_{k}"), F.when(part(3 * k) != "", part(3 * k)).alias(f"icode_{k}"))])
    place = F.when(F.col("section") == "adjacent", 3).otherwise(2)
    topology = F.get("f", place)
    stacks = rows.where(F.col("section").isin("adjacent", "stackings") & topology.isin(*TOPOLOGIES)).withColumns({"kind": F.lit("stacking"), "topology": topology, "code": topology})
    pairs = rows.where("section = 'pairs'").withColumn("t", F.slice("f", 4, F.size("f")))
    holds = lambda atom: F.filter("t", lambda x: x.contains(atom))
    ribose, phosphate = F.get(holds(MC_RIBOSE), F.lit(0)), F.get(F.filter("t", lambda x: x.contains(MC_PHOSPHATE) & ~x.contains(MC_RIBOSE)), F.lit(0))
    edged = F.filter("t", lambda x: x.rlike("^(" + "|".join(MC_EDGES) + ")/(" + "|".join(MC_EDGES) + ")$"))
    token = F.get(edged, F.lit(0))
    side = F.when(F.array_contains("t", "cis"), "c").when(F.array_contains("t", "trans"), "t")
    edge = lambda k: lookup(F.get(F.split(token, "/"), F.lit(k)), MC_EDGES)
    lw = F.concat(side, edge(0), edge(1))
    romans = F.filter("t", lambda x: F.split(x, ",")[0].rlike("^[IVX]+$"))
    single = F.array_contains("t", "one_hbond") & ribose.isNull() & phosphate.isNull()
    turned = lambda c, atom: F.split(c, "/")[0] == atom
    none = F.lit(None).cast("string")
    entry = lambda kind, turn, lw_, saenger, code: F.struct(F.lit(kind).alias("kind"), F.coalesce(turn, F.lit(False)).alias("turn"), lw_.alias("lw"), saenger.alias("saenger"), code.alias("code"))
    found = F.array(
        F.when(single, entry("other", F.lit(False), none, none, F.array_join("t", " "))),
        F.when(~single & ribose.isNotNull(), entry("base-ribose", turned(ribose, MC_RIBOSE), none, none, ribose)),
        F.when(~single & phosphate.isNotNull(), entry("base-phosphate", turned(phosphate, MC_PHOSPHATE), none, none, phosphate)),
        F.when(~single & lw.isNotNull(), entry("base-pair", F.lit(False), lw, F.split(F.get(romans, F.lit(0)), ",")[0], token)),
    )
    pairs = pairs.withColumn("e", F.explode(F.array_compact(found)))
    swap = lambda c, k: F.when(F.col("e.turn"), F.col(f"{c}_{3 - k}")).otherwise(F.col(f"{c}_{k}")).alias(f"{c}_{k}")
    pairs = pairs.select("path", *[swap(c, k) for k in (1, 2) for c in ("chain", "number", "icode")], "e.kind", "e.lw", "e.saenger", "e.code")
    out = unified(stacks, "mc-annotate").unionByName(unified(pairs, "mc-annotate"))
    if names is not None:
        for k in (1, 2):
            known = names.select(F.col("chain_id").alias("_c"), F.col("residue_number").alias("_n"), F.col("insertion_code").alias("_i"), F.col("residue_name").alias("_name")).distinct()
            out = out.join(known, F.col(f"chain_{k}").eqNullSafe(F.col("_c")) & F.col(f"number_{k}").eqNullSafe(F.col("_n")) & F.col(f"icode_{k}").eqNullSafe(F.col("_i")), "left").withColumn(f"name_{k}", F.col("_name")).drop("_c", "_n", "_i", "_name")
    return out


def read_mc_annotate(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    return parse_mc_annotate(scan_lines(spark, path), names)


def has_alternative(*fields: Column) -> Column:
    """Any of the fields of alternate locations and symmetry operations is filled in."""
    out = F.lit(False)
    for f in fields:
        out = out | ~F.coalesce(F.trim(f.cast("string")), F.lit("")).isin("", "None", "nan")
    return out


def parse_dnatco(rows: DataFrame) -> DataFrame:
    """Base pairs of rows with chain, nr, res, ins, alt and symmetry_operation of both residues, and family.

    Rows with an alternate location or a symmetry operation, and rows whose family is no class, are left out.
    """
    rows = rows.where(~has_alternative(*[F.col(c) for c in ("alt1", "symmetry_operation1", "alt2", "symmetry_operation2")]))
    named = {f"{n}_{k}": _real(F.col(f"{o}{k}").cast("string")) for k in (1, 2) for n, o in (("chain", "chain"), ("icode", "ins"), ("name", "res"))}
    rows = rows.withColumns({**named, **{f"number_{k}": F.col(f"nr{k}").try_cast("int") for k in (1, 2)}, "lw": lw_text(F.substring("family", 1, 3)), "code": F.col("family"), "kind": F.lit("base-pair")})
    return unified(rows.where("lw is not null"), "dnatco")


def read_dnatco(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True).select("*", F.col("_metadata.file_path").alias("path"))
    return parse_dnatco(rows)


def barnaba_units(lines: DataFrame) -> DataFrame:
    """(path, unit, name, number, index) of the residues in the first sequence comment of each file."""
    v = F.col("value")
    heads = lines.where(v.startswith("# sequence")).groupBy("path").agg(F.min_by("value", "line_number").alias("value"))
    text = F.get(F.split(F.trim(v), r"\s+"), F.lit(2))
    units = heads.select("path", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+_-?\d+_\d+)")))).alias("unit"))
    part = lambda i: F.split("unit", "_")[i]
    return units.select("path", "unit", part(0).alias("name"), part(1).cast("int").alias("number"), part(2).cast("int").alias("index"))


def best_assignment(score: list[list[float]]) -> list[int]:
    """A column for each row (-1: none) so that the sum of scores is largest, by shortest augmenting paths."""
    n, m = len(score), len(score[0]) if score else 0
    if n > m:
        turned = best_assignment([[score[i][j] for i in range(n)] for j in range(m)])
        return [turned.index(i) if i in turned else -1 for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        low, way, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[at] = True
            row, delta, following = owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -score[row - 1][j - 1] - u[row] - v[j]
                    if cost < low[j]:
                        low[j], way[j] = cost, at
                    if low[j] < delta:
                        delta, following = low[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            at = following
            if not owner[at]:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assign_chains(units: DataFrame, residues: DataFrame) -> DataFrame:
    """(path, index, chain_id): the chain that each of a tool's indices stands for, one to one.

    A pair scores for residues with the same number and name, and a little for the same number. ``residues``: chain_id,
    residue_number, residue_name. Scores are counted distributed; the assignment of a file is as large as its chains.
    """
    known = residues.select("chain_id", F.col("residue_number").alias("number"), F.col("residue_name").alias("known")).distinct()
    scores = units.join(known, "number").groupBy("path", "index", "chain_id").agg((F.sum((F.col("name") == F.col("known")).cast("double")) + 1e-6 * F.count("*")).alias("score"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="index", columns="chain_id", values="score", fill_value=0.0)
        chosen = best_assignment(grid.to_numpy().tolist())
        rows = [(pdf["path"].iloc[0], int(i), grid.columns[j]) for i, j in zip(grid.index, chosen) if j >= 0]
        return pd.DataFrame(rows, columns=["path", "index", "chain_id"])

    return scores.groupBy("path").applyInPandas(run, "path string, index int, chain_id string")


def parse_barnaba(lines: DataFrame, residues: DataFrame) -> DataFrame:
    """Interactions of pairing and stacking files (path, line_number, value), told apart by their names.

    Units (name, number, index) are matched with ``residues`` (chain_id, residue_number, insertion_code, residue_name) by
    number and assigned chain; lines with units that have no match are left out.
    """
    units = barnaba_units(lines)
    known = residues.select("chain_id", F.col("residue_number").alias("number"), "insertion_code", F.col("residue_name").alias("known")).dropDuplicates(["chain_id", "number"])
    matched = units.join(assign_chains(units, residues), ["path", "index"]).join(known, ["chain_id", "number"])
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#")).withColumn("f", f).where(F.size("f") >= 3).select("path", "line_number", F.col("f")[0].alias("unit_1"), F.col("f")[1].alias("unit_2"), F.col("f")[2].alias("code"))
    for k in (1, 2):
        side = matched.select("path", F.col("unit").alias(f"unit_{k}"), F.col("chain_id").alias(f"chain_{k}"), F.col("number").alias(f"number_{k}"), F.col("insertion_code").alias(f"icode_{k}"), F.col("known").alias(f"name_{k}"))
        rows = rows.join(side, ["path", f"unit_{k}"])
    pairing = F.col("path").rlike("pairing[^/]*$")
    lw = F.when(F.lower("code").contains("x"), F.lit(None)).when(F.col("code").isin("WCc", "GUc"), "cWW").otherwise(lw_text(F.concat(F.substring("code", 3, 1), F.substring("code", 1, 2))))
    topology = lookup(F.col("code"), BARNABA_STACKS)
    rows = rows.withColumns({"lw": F.when(pairing, lw), "topology": F.when(~pairing, topology)})
    kind = F.when(F.col("lw").isNotNull(), "base-pair").when(F.col("topology").isNotNull(), "stacking").when(pairing, "other")
    return unified(rows.withColumn("kind", kind).where("kind is not null"), "barnaba")


def read_barnaba(spark: SparkSession, path: str, residues: DataFrame) -> DataFrame:
    return parse_barnaba(scan_lines(spark, path), residues)
