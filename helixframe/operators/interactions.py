"""All interactions of annotated structures: backbone contacts, one table, lookups, strands and their text forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import chemistry, geometry
from helixframe.functions.residues import full_name
from helixframe.operators import annotate
from helixframe.operators.groups import merge_codes
from helixframe.operators.secondary import dot_bracket_of, orders_first_come
from helixframe.operators.spatial import radius_join
from helixframe.plans.storage import materialize

# Oxygens that accept bonds of bases.
PHOSPHATE, RIBOSE = ("OP1", "OP2", "O5'", "O3'"), ("O4'", "O2'")
KINDS = {"base-pair": "base pair", "stacking": "stacking", "base-phosphate": "base-phosphate interaction", "base-ribose": "base-ribose interaction", "other": "other interaction"}


def backbone_contacts(table: DataFrame) -> DataFrame:
    """(path, model, residue_1, residue_2, kind, code): bases (residue_1) at phosphates and riboses of other residues.

    ``table`` is that of :func:`annotate.bases`. Contacts within the length of a hydrogen bond are taken in order of
    distance; an atom serves once. Of the classes of one pair, 3 and 5 make 4, 7 and 9 make 8, and the first counts.
    """
    atoms = table.select("path", "model", "residue", "letter", "atoms", F.explode("atoms").alias("atom", "p"))
    gives = F.coalesce(F.array_contains(annotate._listed(annotate.DONORS, F.col("letter")), F.col("atom")), F.lit(False)) & (F.col("atom") != "O2'")
    atoms = atoms.withColumn("donor", gives).withColumn("kind", F.when(F.col("atom").isin(*PHOSPHATE), "base-phosphate").when(F.col("atom").isin(*RIBOSE), "base-ribose"))
    atoms = atoms.where("donor or kind is not null")
    names = sorted({*PHOSPHATE, *RIBOSE, *(n for v in annotate.DONORS.values() for n in v)})
    atoms = atoms.withColumn("id", F.col("residue").cast("long") * 64 + F.array_position(F.array(*map(F.lit, names)), F.col("atom")))
    pairs = radius_join(atoms.select("path", "model", "id", "p"), annotate.BOND, within=("path", "model"))
    both = pairs.select("path", "model", F.col("id_1").alias("d"), F.col("id_2").alias("a"), "distance").unionByName(pairs.select("path", "model", F.col("id_2").alias("d"), F.col("id_1").alias("a"), "distance"))
    donors = atoms.where("donor").select("path", "model", F.col("id").alias("d"), F.col("residue").alias("residue_1"), "letter", F.col("atom").alias("name"), "atoms", F.col("p").alias("from"))
    takers = atoms.where("kind is not null").select("path", "model", F.col("id").alias("a"), F.col("residue").alias("residue_2"), "kind", F.col("p").alias("to"))
    found = both.join(donors, ["path", "model", "d"]).join(takers, ["path", "model", "a"]).where("residue_1 <> residue_2")
    code = chemistry.backbone_class(F.col("letter"), F.col("name"), F.col("atoms"), F.col("from"), F.col("to"))
    found = found.withColumn("code", code).where("code is not null").select("path", "model", "d", "a", "distance", "residue_1", "residue_2", "kind", "code")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        keep = []
        pdf = pdf.sort_values(["distance", "d", "a"])
        for d, a in zip(pdf["d"], pdf["a"]):
            keep.append(d not in used and a not in used)
            if keep[-1]:
                used |= {d, a}
        return pdf.loc[keep, ["path", "model", "residue_1", "residue_2", "kind", "code"]]

    taken = found.groupBy("path", "model").applyInPandas(choose, "path string, model int, residue_1 long, residue_2 long, kind string, code int")
    return taken.groupBy("path", "model", "residue_1", "residue_2", "kind").agg(merge_codes(F.collect_set("code")).alias("code"))


def interactions(atoms: DataFrame, order: str = "line_number", standards: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The bases of structures, and all their interactions: path, model, residue_1, residue_2, kind, lw, saenger, topology, code.

    The bases are written once; pairs, stackings and contacts read them.
    """
    table = materialize(annotate.bases(atoms, order, standards), "bases")
    letters = [table.select("path", "model", F.col("residue").cast("long").alias(f"residue_{k}"), F.col("letter").alias(f"letter_{k}")) for k in (1, 2)]
    pairs = annotate.base_pairs(table).join(letters[0], ["path", "model", "residue_1"]).join(letters[1], ["path", "model", "residue_2"])
    none = F.lit(None).cast("string")
    columns = ["path", "model", "residue_1", "residue_2", "kind", "lw", "saenger", "topology", "code"]
    pairs = pairs.withColumns({"kind": F.lit("base-pair"), "saenger": chemistry.saenger(F.col("letter_1"), F.col("letter_2"), F.col("lw")), "topology": none, "code": none})
    stacks = annotate.stackings(table).withColumns({"kind": F.lit("stacking"), "lw": none, "saenger": none, "code": none})
    backbone = backbone_contacts(table).withColumns({"lw": none, "saenger": none, "topology": none, "code": F.concat(F.col("code").cast("string"), F.when(F.col("kind") == "base-phosphate", "BPh").otherwise("BR"))})
    return table, pairs.select(*columns).unionByName(stacks.select(*columns)).unionByName(backbone.select(*columns))


def named(found: DataFrame, table: DataFrame) -> DataFrame:
    """Interactions with the readable names nt_1 and nt_2 of their residues."""
    for k in (1, 2):
        names = table.select("path", "model", F.col("residue").cast("long").alias(f"residue_{k}"), full_name(F.coalesce("chain_id", F.lit("")), F.col("residue_name"), F.col("residue_number"), F.col("insertion_code")).alias(f"nt_{k}"))
        found = found.join(names, ["path", "model", f"residue_{k}"])
    return found


def csv_rows(found: DataFrame) -> DataFrame:
    """(path, nt1, nt2, type, classification-1, classification-2) of named interactions, ready to be written as CSV."""
    first = F.when(F.col("kind") == "base-pair", F.col("lw")).when(F.col("kind") == "stacking", F.col("topology")).when(F.col("kind") == "other", F.lit(None)).otherwise(F.col("code"))
    second = F.when(F.col("kind") == "base-pair", F.col("saenger"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return found.select("path", F.col("nt_1").alias("nt1"), F.col("nt_2").alias("nt2"), chemistry.lookup(F.col("kind"), KINDS).alias("type"), blank(first).alias("classification-1"), blank(second).alias("classification-2"))


def json_documents(found: DataFrame) -> DataFrame:
    """(path, content): each structure's interactions as one JSON text, lists by kind, in order of residues."""
    entry = F.struct("residue_1", "residue_2", "nt_1", "nt_2", "lw", "saenger", "topology", "code")
    grouped = found.groupBy("path").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in KINDS])
    plain = lambda k: F.transform(F.col(f"`{k}`"), lambda x: x.dropFields("residue_1", "residue_2")).alias(k.replace("-", "_"))
    return grouped.select("path", F.to_json(F.struct(*[plain(k) for k in KINDS])).alias("content"))


def find_residues(units: DataFrame, residues: DataFrame, label: list[str], author: list[str]) -> DataFrame:
    """``units`` with ``found``, the residue whose label id they name, else the one whose author id they name.

    ``residues`` has the columns of both ids and ``residue``; the smallest one counts where ids repeat.
    """
    def by(keys: list[str], name: str) -> DataFrame:
        return residues.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("residue").alias(name))

    out = units
    for keys, name in ((label, "_by_label"), (author, "_by_author")):
        known = by(keys, name)
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(known, match, "left").drop(*[f"_{k}" for k in keys])
    return out.withColumn("found", F.coalesce("_by_label", "_by_author")).drop("_by_label", "_by_author")


def fill_saenger(pairs: DataFrame, letters: DataFrame) -> DataFrame:
    """Pairs (residue_1, residue_2, lw, saenger) of any tool with missing Saenger classes filled in from (residue, letter)."""
    for k in (1, 2):
        pairs = pairs.join(letters.select(F.col("residue").alias(f"residue_{k}"), F.upper("letter").alias(f"_letter_{k}")), f"residue_{k}", "left")
    return pairs.withColumn("saenger", F.coalesce("saenger", chemistry.saenger(F.col("_letter_1"), F.col("_letter_2"), F.col("lw")))).drop("_letter_1", "_letter_2")


def both_directions(found: DataFrame) -> DataFrame:
    """Distinct edges (path, residue_1, residue_2, lw or topology) and their reverses."""
    turned = found.withColumns({"residue_1": F.col("residue_2"), "residue_2": F.col("residue_1"), "lw": chemistry.reverse_lw(F.col("lw")), "topology": chemistry.reverse_topology(F.col("topology"))})
    return found.unionByName(turned).dropDuplicates(["path", "residue_1", "residue_2", "lw", "topology"])


def gapped_places(residues: DataFrame, find_gaps: bool = True) -> DataFrame:
    """``residues`` (path, residue, chain_id, residue_number, connected) with ``gap`` and ``place``.

    place numbers residues from 1 in order; with ``find_gaps``, a residue that is not connected to the one before in its
    chain leaves out as many places as the numbers between them.
    """
    window = Window.partitionBy("path").orderBy("residue")
    missing = F.col("residue_number") - F.lag("residue_number").over(window) - 1
    same = F.lag("chain_id").over(window).eqNullSafe(F.col("chain_id")) & (F.row_number().over(window) > 1)
    gap = F.when(same & ~F.col("connected") & (missing > 0), missing).otherwise(0) if find_gaps else F.lit(0)
    marked = residues.withColumn("gap", gap.cast("int"))
    return marked.withColumn("place", (F.row_number().over(window) + F.sum("gap").over(window.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))


def bpseq_with_gaps(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, i, base, pair) of :func:`gapped_places` with ``letter``; places left out are ? and unpaired.

    ``pairs``: path, residue_1, residue_2, each residue in one pair at most.
    """
    ends = pairs.select("path", F.col("residue_1").alias("residue"), F.col("residue_2").alias("mate")).unionByName(pairs.select("path", F.col("residue_2").alias("residue"), F.col("residue_1").alias("mate")))
    mates = ends.join(placed.select("path", F.col("residue").alias("mate"), F.col("place").alias("pair")), ["path", "mate"]).groupBy("path", "residue").agg(F.min("pair").alias("pair"))
    real = placed.join(mates, ["path", "residue"], "left").select("path", F.col("place").alias("i"), F.col("letter").alias("base"), F.coalesce("pair", F.lit(0)).alias("pair"))
    left_out = placed.where("gap > 0").select("path", F.explode(F.sequence(F.col("place") - F.col("gap"), F.col("place") - 1)).alias("i"), F.lit("?").alias("base"), F.lit(0).alias("pair"))
    return real.unionByName(left_out)


def strand_sequences(placed: DataFrame) -> DataFrame:
    """(path, strand, chain_id, sequence, first): each run of residues of one chain as text, ? for places left out."""
    window = Window.partitionBy("path").orderBy("residue")
    change = F.when(F.lag("chain_id").over(window).eqNullSafe(F.col("chain_id")) & (F.row_number().over(window) > 1), 0).otherwise(1)
    marked = placed.withColumn("_change", change).withColumn("strand", F.sum("_change").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.concat(F.repeat(F.lit("?"), F.col("gap")), F.col("letter"))
    grouped = marked.groupBy("path", "strand", "chain_id").agg(F.sort_array(F.collect_list(F.struct("residue", text.alias("t")))).alias("t"), F.min("place").alias("first"))
    return grouped.select("path", "strand", "chain_id", F.array_join("t.t", "").alias("sequence"), "first")


def split_by_strand(structures: DataFrame, strands: DataFrame) -> DataFrame:
    """(path, strand, structure): the part of each whole structure text that belongs to a strand, by lengths in order."""
    before = F.sum(F.length("sequence")).over(Window.partitionBy("path").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1))
    cut = strands.select("path", "strand", F.length("sequence").alias("_n"), (F.coalesce(before, F.lit(0)) + 1).alias("_at"))
    return structures.join(cut, "path").select("path", "strand", F.expr("substring(structure, cast(_at as int), cast(_n as int))").alias("structure"))


def pair_rank(one: Column, two: Column, saenger_class: Column) -> Column:
    """0 for XIX and XX or AU, AT and CG; 1 for XXVIII or GU and GT; 2 for others."""
    one, two = F.upper(one), F.upper(two)
    bases = F.concat(F.least(one, two), F.greatest(one, two))
    by_class = F.when(saenger_class.isin("XIX", "XX"), 0).when(saenger_class == "XXVIII", 1).otherwise(2)
    return F.when(saenger_class.isNotNull(), by_class).when(bases.isin("AU", "AT", "CG"), 0).when(bases.isin("GU", "GT"), 1).otherwise(2)


def prune_conflicts(pairs: DataFrame) -> DataFrame:
    """Pairs (path, residue_1, residue_2, rank) so that each residue keeps one: while a residue has more, in the order in
    which residues first occur, its last pair by rank goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [(int(a), int(b), int(r)) for a, b, r in zip(pdf["residue_1"], pdf["residue_2"], pdf["rank"])]
        left.sort(key=lambda p: p[:2])
        while True:
            held: dict[int, list] = {}
            for p in left:
                held.setdefault(p[0], []).append(p)
                held.setdefault(p[1], []).append(p)
            crowded = next((v for v in held.values() if len(v) > 1), None)
            if crowded is None:
                break
            left.remove(sorted(crowded, key=lambda p: p[2])[-1])
        return pd.DataFrame({"path": pdf["path"].iloc[0] if len(pdf) else "", "residue_1": [p[0] for p in left], "residue_2": [p[1] for p in left]})

    return pairs.select("path", "residue_1", "residue_2", "rank").groupBy("path").applyInPandas(run, "path string, residue_1 long, residue_2 long")


def extended_dot_bracket(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, strand, lw, row, structure): for each class its pairs as dot-brackets per strand, in up to two rows.

    A pair goes to the first row if none of its residues has one there, else to the second. ``pairs``: path, residue_1 <
    residue_2, lw.
    """
    spots = [placed.select("path", F.col("residue").alias(f"residue_{k}"), F.col("place").alias(c)) for k, c in ((1, "i"), (2, "j"))]
    located = pairs.select("path", "residue_1", "residue_2", "lw").join(spots[0], ["path", "residue_1"]).join(spots[1], ["path", "residue_2"]).where("i < j")

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        row = []
        pdf = pdf.sort_values(["i", "j"])
        for i, j in zip(pdf["i"], pdf["j"]):
            free = i not in used and j not in used
            row.append(1 if free else 2)
            if free:
                used |= {i, j}
        return pdf.assign(row=row)[["path", "lw", "row", "i", "j"]]

    dealt = located.select("path", "lw", "i", "j").groupBy("path", "lw").applyInPandas(rows, "path string, lw string, row int, i int, j int")
    dealt = dealt.dropDuplicates(["path", "lw", "row", "i"]).dropDuplicates(["path", "lw", "row", "j"])
    key = F.to_json(F.struct("path", "lw", "row"))
    ordered = orders_first_come(dealt.select(key.alias("id"), "i", "j"))
    lengths = dealt.select("path", "lw", "row").distinct().join(placed.groupBy("path").agg(F.max("place").alias("n")), "path").select(key.alias("id"), "n")
    texts = dot_bracket_of(lengths, ordered)
    parts = F.from_json("id", "path string, lw string, row int")
    texts = texts.select(parts.alias("k"), "structure").select("k.path", "k.lw", "k.row", "structure")
    strands = strand_sequences(placed).select("path", "strand", "sequence")
    before = F.sum(F.length("sequence")).over(Window.partitionBy("path").orderBy("strand").rowsBetween(Window.unboundedPreceding, -1))
    cut = strands.select("path", "strand", F.length("sequence").alias("_n"), (F.coalesce(before, F.lit(0)) + 1).alias("_at"))
    return texts.join(cut, "path").select("path", "strand", "lw", "row", F.expr("substring(structure, cast(_at as int), cast(_n as int))").alias("structure"))


def connected(table: DataFrame, limit: float = 2.4) -> DataFrame:
    """``table`` (path, residue, atoms) with ``connected``: the residue's P is bonded to the O3' of the one before."""
    window = Window.partitionBy("path").orderBy("residue")
    at = lambda n: F.try_element_at("atoms", F.lit(n))
    return table.withColumn("connected", F.coalesce(geometry.distance(F.lag(at("O3'")).over(window), at("P")) < limit, F.lit(False)))
