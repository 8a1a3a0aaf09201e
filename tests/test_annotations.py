"""Outputs of annotation tools."""

from pyspark.sql import functions as F

from helixframe.sources import annotations


def rows(df):
    return sorted((r.kind, r.chain_1, r.number_1, r.name_1, r.chain_2, r.number_2, r.name_2, r.lw, r.saenger, r.topology) for r in df.collect())


def test_tools(spark, tmp_path):
    (tmp_path / "a.txt").write_text("X|1|A|G|1\tcWW\tX|1|B|C|6\t0\nX|1|A|G|1\tncsSa\tX|1|A|C|6\t0\nX|1|A|G|1\ts35\tX|1|A|C|2\t0\nX|1|A|G|1\t5BPh\tX|1|A|C|2\t0\nnote\n")
    assert rows(annotations.read_fr3d(spark, str(tmp_path / "a.txt"))) == [
        ("base-pair", "A", 1, "G", "A", 6, "C", "cSS", None, None), ("base-pair", "A", 1, "G", "B", 6, "C", "cWW", None, None),
        ("base-phosphate", "A", 1, "G", "A", 2, "C", None, None, None), ("stacking", "A", 1, "G", "A", 2, "C", None, None, "outward"),
    ]
    (tmp_path / "b.json").write_text('{"basepairs": [{"resnum1": 68, "chain1": "A", "ins1": null, "resname1": "G", "resnum2": 108, "chain2": "B", "ins2": null, "resname2": "C", "basepair": "W:WC", "eval": 0.2}, {"resnum1": 1, "chain1": "A", "resname1": "G", "resnum2": 2, "chain2": "B", "resname2": "C", "basepair": "g:zT"}]}')
    assert [r[7] for r in rows(annotations.read_bpnet(spark, str(tmp_path / "b.json")))] == ["tHS", "cWW"]
    (tmp_path / "c.json").write_text('{"pairs": [{"nt1": "A.G1", "nt2": "B.5MC/40^A", "LW": "cWW", "Saenger": "19-XIX"}], "stacks": [{"nts_long": "A.G1,A.C2,A.DG3"}]}')
    assert rows(annotations.read_dssr(spark, str(tmp_path / "c.json"))) == [
        ("base-pair", "A", 1, "G", "B", 40, "5MC", "cWW", None, None), ("stacking", "A", 1, "G", "A", 2, "C", None, None, None), ("stacking", "A", 2, "C", "A", 3, "DG", None, None, None),
    ]
    names = ["i_auth_asym_id", "i_auth_seq_id", "i_PDB_ins_code", "i_label_comp_id", "j_auth_asym_id", "j_auth_seq_id", "j_PDB_ins_code", "j_label_comp_id", "hbond_type_28", "hbond_type_12"]
    (tmp_path / "d.cif").write_text("data_x\nloop_\n" + "".join(f"_ndb_struct_na_base_pair.{n}\n" for n in names) + "A 1 ? G B 6 ? C 19 1\nA 2 ? G B 5 ? A ? ?\n")
    assert [(r[0], r[7], r[8]) for r in rows(annotations.read_maxit(spark, str(tmp_path / "d.cif")))] == [("base-pair", "cWW", "XIX"), ("other", None, None)]
    kinds = spark.createDataFrame([("x/basepair.json", ""), ("a_basepair_detail.txt", ""), ("q.json", ""), ("m.cif", "data_")], "n string, h string").select(annotations.detect_tool(F.col("n"), F.col("h")).alias("t"))
    assert [r.t for r in kinds.collect()] == ["bpnet", "fr3d", "dssr", "maxit"]


def test_bpnet_contacts(spark, tmp_path):
    """Stackings and backbone contacts of the .rob file beside the pairs of the JSON."""
    (tmp_path / "x_basepair.json").write_text('{"basepairs": [{"resnum1": 1, "chain1": "A", "ins1": "?", "resname1": "G", "resnum2": 9, "chain2": "A", "ins2": " ", "resname2": "C", "basepair": "W:WC"}]}')
    lines = [
        "OVLP 1 ? 1:2 B G:C A^A ASTK 9 9 9 9 9", "OVLP 1 ? 1:3 ? G:C A^? ADJA 9 9 9 9 9", "OVLP 1 ? 1:4 ? G:C A^A NONE 9 9 9 9 9", "OVLP 1 ? 1:5 ? G:C A^A ASTK 9",
        "PROX 1 ? 1:6 ? G:U A^B N1:OP1 9 9 9", "PROX 1 ? 1:7 ? G:U A^B O2*:C5 9 9 9", "PROX 1 ? 1:8 ? G:U A^B N1:N3 9 9 9", "PROX 1 ? 1:9 ? G:U A^B N1:N3 9 9", "note",
    ]
    (tmp_path / "x.rob").write_text("\n".join(lines) + "\n")
    found = [(r.kind, r.chain_1, r.number_1, r.chain_2, r.number_2, r.icode_1, r.icode_2, r.code) for r in annotations.read_bpnet(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted([
        ("base-pair", "A", 1, "A", 9, None, None, "W:WC"), ("stacking", "A", 1, "A", 2, None, "B", "ASTK"), ("stacking", "A", 1, None, 3, None, None, "ADJA"),
        ("base-phosphate", "A", 1, "B", 6, None, None, "N1:OP1"), ("other", "A", 1, "B", 6, None, None, "N1:OP1"),
        ("base-ribose", "B", 7, "A", 1, None, None, "O2*:C5"), ("other", "A", 1, "B", 7, None, None, "O2*:C5"), ("other", "A", 1, "B", 8, None, None, "N1:N3"),
    ], key=str)


def test_dssr_models(spark, tmp_path):
    model = '{"model": %d, "parameters": {"pairs": [{"nt1": "A.G%d", "nt2": "A.C9", "LW": "cWW"}], "stacks": [{"nts_long": "A.G%d,A.C7"}]}}'
    (tmp_path / "m.json").write_text('{"num_models": 2, "models": [%s, %s]}' % (model % (1, 1, 2), model % (5, 3, 4)))
    numbers = lambda m: [(r[0], r[2]) for r in rows(annotations.read_dssr(spark, str(tmp_path / "m.json"), m))]
    assert numbers(None) == numbers(1) == [("base-pair", 1), ("stacking", 2)]
    assert numbers(5) == [("base-pair", 3), ("stacking", 4)] and numbers(2) == []
