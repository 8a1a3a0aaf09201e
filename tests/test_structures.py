"""Sources, secondary structure, graph and spatial operators against small brute-force versions."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions import residues
from helixframe.operators import groups, secondary, spatial
from helixframe.plans.components import connected_components
from helixframe.sources import cif, pdb
from helixframe.sources import secondary as texts


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_radius_join(spark):
    rng = np.random.default_rng(1)
    points = rng.random((300, 3)) * 4 - 2
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, p array<double>")
    got = {(r.id_1, r.id_2) for r in spatial.radius_join(df, 0.45).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(300), 2) if np.linalg.norm(points[i] - points[j]) <= 0.45}


def test_pdb_round_trip(spark, tmp_path):
    lines = ["MODEL        1", "ATOM      1  P     A A   1      -1.500   2.250   3.000  1.00 10.00           P  ", "HETATM    2 HO5'AMTU B  12A    100.000  -0.125   0.000  0.50  0.00           H1+", "MODEL      bad", "ATOM      3  C1'   G A   2       0.000   0.000   1.000  1.00  0.00           C  ", "MODRES 1ABC MTU B   12A   U  modified"]
    (tmp_path / "x.pdb").write_text("\n".join(lines) + "\n")
    atoms = pdb.read_pdb(spark, str(tmp_path)).orderBy("line_number").collect()
    assert [(a.serial, a.atom_name, a.alt_loc, a.residue_name, a.chain_id, a.residue_number, a.insertion_code, a.x, a.model) for a in atoms] == [(1, "P", None, "A", "A", 1, None, -1.5, 1), (2, "HO5'", "A", "MTU", "B", 12, "A", 100.0, 1), (3, "C1'", None, "G", "A", 2, None, 0.0, 1)]
    c = F.col
    written = pdb.parse_atom_lines(spark.read.text(str(tmp_path)).select(F.lit("x").alias("path"), F.lit(0).alias("line_number"), "value"))
    line = pdb.atom_line(record=c("record_type"), serial=c("serial"), name=c("atom_name"), alt=c("alt_loc"), residue=c("residue_name"), chain=c("chain_id"), number=c("residue_number"), icode=c("insertion_code"), x=c("x"), y=c("y"), z=c("z"), occupancy=c("occupancy"), b=c("b_factor"), element=c("element"), charge=c("charge"))
    assert {r[0] for r in written.select(line).collect()} == {x for x in lines if x.startswith(("ATOM", "HETATM"))}
    mods = pdb.read_modres(spark, str(tmp_path)).collect()
    assert [(m.residue_name, m.chain_id, m.residue_number, m.insertion_code, m.standard_name) for m in mods] == [("MTU", "B", 12, "A", "U")]


CIF = """data_TEST
# a note
_entry.id 'TE ST'
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.auth_asym_id
ATOM 1 C "C1'" G A 1 1.0 2.0 3.5 X
ATOM 2 O 'O5'' G A . 1.0 ? 3.5 X
#
_struct.title
;long
text; here
;
"""


def test_cif(spark, tmp_path):
    (tmp_path / "x.cif").write_text(CIF)
    categories = cif.read_categories(spark, str(tmp_path)).cache()
    assert {r.category for r in cif.list_categories(categories).collect()} == {"entry", "atom_site", "struct"}
    assert cif.category(categories, "entry", ["id"]).first().id == "TE ST"
    assert cif.category(categories, "struct", ["title"]).first().title == "long\ntext; here"
    atoms = cif.read_atoms(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(a.atom_name, a.chain_id, a.residue_number, a.x, a.y) for a in atoms] == [("C1'", "X", 1, 1.0, 2.0), ("O5'", "X", None, 1.0, None)]
    items = ["group_PDB", "id", "label_atom_id"]
    text = cif.write_category(cif.category(categories, "atom_site", items), "atom_site", items).first().content
    assert [r[3] for r in cif.rows("data_x\n" + text)] == [{"group_PDB": "ATOM", "id": "1", "label_atom_id": "C1'"}, {"group_PDB": "ATOM", "id": "2", "label_atom_id": "O5'"}]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nacgt\nTT\n>two\nGG\n")
    assert [(r.header, r.sequence) for r in texts.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("record").collect()] == [("one x", "ACGUUU"), ("two", "GG")]
    (tmp_path / "a.bpseq").write_text("1 A 3\nbad line here x\n2 C 0\n3 U 1\n")
    assert [tuple(r)[1:] for r in texts.read_bpseq(spark, str(tmp_path / "a.bpseq")).orderBy("i").collect()] == [(1, "A", 3), (2, "C", 0), (3, "U", 1)]
    (tmp_path / "a.dbn").write_text(">s1\nACGU\n(..)\n>s2\nGG\n..\n")
    assert [(r.header, r.sequence, r.structure, r["first"]) for r in texts.read_dot_bracket(spark, str(tmp_path / "a.dbn")).orderBy("strand").collect()] == [(">s1", "ACGU", "(..)", 1), (">s2", "GG", "..", 5)]


def random_structure(rng, n):
    text = ["."] * n
    for opening, closing in ("()", "[]", "{}", "Aa"):
        stack = []
        for k in range(n):
            if text[k] == "." and rng.random() < 0.25:
                if stack and rng.random() < 0.5:
                    text[stack.pop()], text[k] = opening, closing
                else:
                    stack.append(k)
    return "".join(text)


def brute_pairs(text):
    out, stacks = [], {}
    for k, c in enumerate(text):
        if c in secondary.OPENING:
            stacks.setdefault(secondary.OPENING.index(c), []).append(k + 1)
        elif c in secondary.CLOSING:
            out.append((stacks[secondary.CLOSING.index(c)].pop(), k + 1))
    return sorted(out)


def test_brackets(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", "A" * 40, random_structure(rng, 40)) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, sequence string, structure string")
    pairs = secondary.pairs_of(df).cache()
    got = {}
    for r in pairs.collect():
        got.setdefault(r.id, []).append((r.i, r.j))
    assert all(sorted(got.get(i, [])) == brute_pairs(t) for i, _, t in rows)
    bpseq = secondary.bpseq_of(df)
    assert bpseq.count() == 1200 and bpseq.where("pair > 0").count() == 2 * pairs.count()
    ordered = secondary.orders_first_come(pairs)
    for r in secondary.dot_bracket_of(df.select("id", F.length("structure").alias("n")), ordered).collect():
        assert brute_pairs(r.structure) == brute_pairs(dict((i, t) for i, _, t in rows)[r.id])
    kept = secondary.without_isolated(pairs)
    stems = secondary.stems_of(pairs)
    assert kept.count() == stems.where("length > 1").agg(F.sum("length")).first()[0]
    assert df.select(secondary.strip_pseudoknots(F.col("structure")).alias("s")).where(F.col("s").rlike("[^().]")).count() == 0


def test_elements(spark):
    # a stem with a hairpin inside an internal loop inside another stem, and both ends
    text = "..((..((...))..))."
    df = spark.createDataFrame([("x", "A" * len(text), text)], "id string, sequence string, structure string")
    out = sorted((r.kind, [(s["first"], s["last"]) for s in r.strands]) for r in secondary.elements_of(secondary.bpseq_of(df)).collect())
    assert out == [("3'", [(17, 18)]), ("5'", [(1, 3)]), ("hairpin", [(8, 12)]), ("loop", [(4, 7), (13, 16)]), ("stem", [(3, 4), (16, 17)]), ("stem", [(7, 8), (12, 13)])]


def test_groups_and_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "t int, k string").withColumn("g", F.lit(1))
    assert [r.run for r in groups.runs(df, ["k"], ["g"], ["t"]).orderBy("t").collect()] == [1, 1, 2, 2, 3]
    crossing = groups.crossing_pairs(spark.createDataFrame([(1, 0, 5), (2, 3, 8), (3, 4, 5)], "id int, i int, j int").withColumn("g", F.lit(1)), ["g"])
    assert [(r["first"], r.second) for r in crossing.collect()] == [(1, 2)]
    row = spark.range(1).select(residues.full_name(F.lit("A"), F.lit("G"), F.lit(10), F.lit(" ")).alias("a"), residues.full_name(F.lit("A"), F.lit("M2"), F.lit(10), F.lit("B")).alias("b"), residues.molecule_class(F.lit("XYZ"), F.array(F.lit("P"), F.lit("O2'"))).alias("c"), residues.atom_radius(F.lit("P")).alias("d")).first()
    assert tuple(row) == ("A.G10", "A.M2/10^B", "RNA", 0.94)
