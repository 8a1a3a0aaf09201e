"""Adapters of annotation tools on short texts in their formats, and chain assignment against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from helixframe.sources import tools

RNAVIEW = """heading
BEGIN_base-pair
     1_72, A:     1 G-C    72 B: +/+ cis         XIX
     2_71, A:     2 G-U    71 ?: W/H tran   syn    n/a
     3_70, A:    -3 A-A    70 B: S/W cis         !1H(b_b).
     4_69, A:     4 A-A    69 B:      stacked
     5_68, A:     5 A-A    68 B: W/. tran    n/a
     6_67, A:     6 A-A    67 B: W/? tran    !(b_s)
     7_66, A:     7 A-A    66 B: ./W tran    !b_(O1P,O2P)
END_base-pair
     8_65, A:     8 G-C    65 B: +/+ cis         XIX
"""
MC = """Residue conformations -------
A1 : G C3p_endo anti
Adjacent stackings ----
A1-A2 : adjacent_5p upward
Non-Adjacent stackings ----
A4.B-'1'7 : inward pairing
Base-pairs ----
A1-A9 : G-C Ww/Ww pairing antiparallel cis XIX
A2-A8 : A-A Hh/Ww O2'/Ws pairing parallel trans XII,XIII one_hbond
A3-A7 : A-U Ww/Hh cis one_hbond
A4.B-A6 : G-G O2P/Bh adjacent_5p cis
A5-A6 : G-G Xx/Yy cis
Number of stackings = 2
"""


def lines(spark, text, path="f"):
    return spark.createDataFrame([(path, i, x) for i, x in enumerate(text.split("\n"))], "path string, line_number int, value string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rnaview(spark):
    out = tools.parse_rnaview(lines(spark, RNAVIEW))
    got = rows(out, "number_1", "kind", "lw", "saenger")
    assert got == sorted([(1, "base-pair", "cWW", "XIX"), (2, "base-pair", "tWH", None), (-3, "other", None, None), (4, "stacking", None, None), (5, "other", None, None), (6, "base-ribose", None, None), (7, "base-phosphate", None, None)], key=lambda r: r[0])
    assert out.where("number_1 = 2 and chain_2 is null").count() == 1
    indices = spark.createDataFrame([(1, "X", 10, None, "PSU"), (72, "Y", 20, "A", "C")], "index int, chain_id string, residue_number int, insertion_code string, residue_name string")
    assert rows(tools.parse_rnaview(lines(spark, RNAVIEW), indices), "chain_1", "number_1", "name_1", "chain_2", "icode_2", "lw") == [("X", 10, "PSU", "Y", "A", "cWW")]


def test_rnaview_indices(spark):
    ring = {"N1": [0.0, 0.0, 0.0], "C2": [1.4, 0.0, 0.0], "C6": [0.0, 1.4, 0.0]}
    table = [("f", 1, "A", 1, None, "G", ring), ("f", 2, "A", 2, None, "G", {**ring, "C6": [0.0, 9.0, 0.0]}), ("f", 3, "A", 3, None, "G", {"N1": [0.0] * 3}), ("f", 4, "A", 4, None, "C", ring)]
    df = spark.createDataFrame(table, "path string, residue int, chain_id string, residue_number int, insertion_code string, residue_name string, atoms map<string,array<double>>")
    assert rows(tools.rnaview_indices(df), "index", "residue_number") == [(1, 1), (2, 4)]


def test_mc_annotate(spark):
    names = spark.createDataFrame([("A", 1, None, "G"), ("A", 4, "B", "PSU")], "chain_id string, residue_number int, insertion_code string, residue_name string")
    out = tools.parse_mc_annotate(lines(spark, MC), names)
    got = sorted(((r.number_1, r.icode_1, r.number_2, r.icode_2, r.kind, r.lw, r.saenger, r.topology) for r in out.collect()), key=str)
    want = [(1, None, 2, None, "stacking", None, None, "upward"), (4, "B", 7, None, "stacking", None, None, "inward"), (1, None, 9, None, "base-pair", "cWW", "XIX", None), (8, None, 2, None, "base-ribose", None, None, None), (2, None, 8, None, "base-pair", "tHW", "XII", None), (3, None, 7, None, "other", None, None, None), (6, None, 4, "B", "base-phosphate", None, None, None)]
    assert got == sorted(want, key=str)
    assert rows(out.where("number_1 = 4"), "name_1", "name_2") == [("PSU", None)]


def test_dnatco(spark, tmp_path):
    (tmp_path / "a.csv").write_text('pdbid,family,chain1,nr1,res1,alt1,ins1,symmetry_operation1,chain2,nr2,res2,alt2,ins2,symmetry_operation2\n1x,cWW,A,1,G,"", ,,B,72,C,"", ,\n1x,tHs,A,2,G,"",C,,?,-3,.,"", ,\n1x,cWW,A,3,G,B, ,,B,70,C,"", ,\n1x,cWW,A,4,G,"", ,2_555,B,69,C,"", ,\n1x,zz,A,5,G,"", ,,B,68,C,"", ,\n')
    assert rows(tools.read_dnatco(spark, str(tmp_path)), "number_1", "icode_1", "chain_2", "number_2", "name_2", "lw") == [(1, None, "B", 72, "C", "cWW"), (2, "C", None, -3, None, "tHS")]


def test_assignment():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        score = [[float(rng.randrange(6)) for _ in range(m)] for _ in range(n)]
        got = tools.best_assignment(score)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used)) == min(n, m)
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = max(sum(score[i][j] if n <= m else score[j][i] for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
        assert sum(score[i][j] for i, j in enumerate(got) if j >= 0) == best


def test_barnaba(spark):
    pairing = "# sequence G_1_0-C_-2_0-A_1_1-U_2_1\n# more\nG_1_0 U_2_1 WCc\nC_-2_0 A_1_1 WHt\nC_-2_0 U_2_1 xxx\nG_9_9 U_2_1 WCc\n"
    stacking = "# sequence G_1_0-C_-2_0-A_1_1-U_2_1\nG_1_0 C_-2_0 >>\nA_1_1 U_2_1 ><\n"
    residues = spark.createDataFrame([("X", 1, None, "A"), ("X", 2, None, "U"), ("Y", 1, None, "G"), ("Y", -2, None, "C")], "chain_id string, residue_number int, insertion_code string, residue_name string")
    text = lines(spark, pairing, "d/my_pairing.out").union(lines(spark, stacking, "d/my_stacking.out"))
    got = rows(tools.parse_barnaba(text, residues).select("*", F.coalesce("lw", "topology", F.lit("-")).alias("c")), "kind", "chain_1", "number_1", "chain_2", "number_2", "c")
    assert got == sorted([("base-pair", "Y", 1, "X", 2, "cWW"), ("base-pair", "Y", -2, "X", 1, "tWH"), ("other", "Y", -2, "X", 2, "-"), ("stacking", "Y", 1, "Y", -2, "upward"), ("stacking", "X", 1, "X", 2, "inward")])
