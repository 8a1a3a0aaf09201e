"""Stacking and base pairs on hand-made bases."""

import math

from helixframe.operators import annotate
from helixframe.sources import cif

HEAD = "path string, line_number int, atom_name string, residue_name string, chain_id string, residue_number int, insertion_code string, x double, y double, z double, model int"
#: Flat rings, good enough for centroids and normals.
ADENINE = {"N9": (0, 0), "C8": (0.8, 1.0), "N7": (2.0, 0.6), "C5": (2.0, -0.8), "C4": (0.8, -1.2), "N3": (0.9, -2.6), "C2": (2.1, -3.1), "N1": (3.2, -2.4), "C6": (3.2, -1.2), "N6": (4.4, -0.6), "C1'": (-1.4, 0.2)}


def place(number, height, turn=0.0, flip=1):
    c, s = math.cos(turn), math.sin(turn)
    return [("f", number * 100 + k, n, "A", "A", number, None, c * x - s * y * flip, s * x + c * y * flip, height, 1) for k, (n, (x, y)) in enumerate(ADENINE.items())]


def test_stacking(spark):
    atoms = spark.createDataFrame(place(1, 0.0) + place(2, 3.4, 0.3) + place(3, 20.0), HEAD)
    table = annotate.bases(atoms)
    assert table.count() == 3
    assert [(r.residue_1, r.residue_2, r.topology) for r in annotate.stackings(table).collect()] == [(1, 2, "upward")]
    turned = annotate.bases(spark.createDataFrame(place(1, 0.0) + place(2, 3.4, 0.3, -1), HEAD))
    assert [r.topology for r in annotate.stackings(turned).collect()] == ["inward"]


def test_pairs(spark):
    """Two adenines in a plane whose Hoogsteen edges face each other by half a turn: N6 to N7 and N7 to N6."""
    shift = (2 * 3.2 + 1.2, 2 * 0.6 + 0.8)
    second = [(p, n + 1000, a, r, c, 2, i, shift[0] - x, shift[1] - y, z, m) for p, n, a, r, c, _, i, x, y, z, m in place(1, 0.0)]
    pairs = annotate.base_pairs(annotate.bases(spark.createDataFrame(place(1, 0.0) + second, HEAD))).collect()
    assert len(pairs) >= 1 and all((r.residue_1, r.residue_2) == (1, 2) and r.bonds >= 2 and r.lw[0] == "t" for r in pairs)
    alone = annotate.base_pairs(annotate.bases(spark.createDataFrame(place(1, 0.0), HEAD)))
    assert alone.count() == 0


def test_modified_residues(spark, tmp_path):
    """Letters by MODRES, by the entity's sequence, by the name and by the atoms; ligands without a base's plane stay out."""
    renamed = lambda rows, name: [(p, k, a, name, c, n, i, x, y, z, m) for p, k, a, _, c, n, i, x, y, z, m in rows]
    atoms = spark.createDataFrame(
        renamed(place(1, 0.0), "1MA") + renamed(place(2, 3.4, 0.3), "XY9") + renamed(place(3, 6.8), "I") + renamed(place(4, 10.2), "QQC")
        + [("f", 900, "C2", "GOL", "A", 9, None, 0.0, 0.0, 14.0, 1), ("f", 901, "N", "ALA", "A", 10, None, 0.0, 0.0, 14.0, 1)], HEAD,
    )
    standards = spark.createDataFrame([("f", "A", 4, None, "QQC", "A")], "path string, chain_id string, residue_number int, insertion_code string, residue_name string, standard_name string")
    table = annotate.bases(atoms, standards=standards)
    assert {r.residue_number: r.letter for r in table.collect()} == {1: "A", 2: "A", 3: "A", 4: "A"}
    assert {(r.residue_1, r.residue_2) for r in annotate.stackings(table).collect()} == {(1, 2), (2, 3), (3, 4)}
    site = ["id", "label_atom_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "auth_asym_id", "auth_seq_id", "auth_comp_id", "pdbx_PDB_ins_code"]
    (tmp_path / "m.cif").write_text(
        "data_x\n_entity_poly.entity_id 1\n_entity_poly.pdbx_seq_one_letter_code_can\n;GU\nA\n;\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in site)
        + "1 N1 PSU A 1 2 B 7 PSU ?\n2 N1 QQC A 1 3 B 8 QQC A\n3 N1 5MC C ? . B 9 5MC ?\n"
        + "loop_\n" + "".join(f"_pdbx_struct_mod_residue.{n}\n" for n in ("auth_asym_id", "auth_seq_id", "PDB_ins_code", "auth_comp_id", "parent_comp_id")) + "B 7 ? PSU G\nB 9 ? 5MC C\n"
    )
    found = cif.standard_names(spark, str(tmp_path / "m.cif")).collect()
    assert sorted((r.chain_id, r.residue_number, r.insertion_code or "", r.residue_name, r.standard_name) for r in found) == [("B", 7, "", "PSU", "U"), ("B", 8, "A", "QQC", "A"), ("B", 9, "", "5MC", "C")]
