"""Category filters and the fit to PDB's limits."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import categories, structure
from helixframe.sources import cif

CIF = """data_x
loop_
_entity_poly.entity_id
_entity_poly.type
1 polyribonucleotide
2 polypeptide(L)
loop_
_struct_asym.id
_struct_asym.entity_id
A 1
B 2
C 1
loop_
_atom_site.id
_atom_site.label_entity_id
_atom_site.label_asym_id
_atom_site.auth_asym_id
1 1 A X
2 2 B Y
3 1 C Z
_cell.length_a 3
"""


def test_filters(spark, tmp_path):
    (tmp_path / "x.cif").write_text(CIF)
    rows = cif.read_categories(spark, str(tmp_path)).cache()

    def ids(df):
        return sorted(r[0] for r in df.where("category = 'atom_site'").select(categories.item("id")).collect())

    nucleic = categories.filter_by_polymer_types(rows, ["polyribonucleotide"])
    assert ids(nucleic) == ["1", "3"] and nucleic.where("category = 'cell'").count() == 1 and nucleic.where("category = 'struct_asym'").count() == 2
    assert ids(categories.filter_by_entities(rows, ["2"])) == ["2"]
    chain = categories.filter_by_chains(rows, ["Z"])
    assert ids(chain) == ["3"] and chain.where("category = 'struct_asym'").count() == 1 and chain.where("category = 'entity_poly'").count() == 1
    copied = categories.copy_item(rows, "atom_site", "auth_asym_id", "new")
    assert sorted(r[0] for r in copied.where("category = 'atom_site'").select(categories.item("new")).collect()) == ["X", "Y", "Z"]
    replaced, mapping = categories.replace_item(rows, "atom_site", "auth_asym_id", "PQR")
    assert {(r.value, r.code) for r in mapping.collect()} == {("X", "P"), ("Y", "Q"), ("Z", "R")}
    assert replaced.count() == rows.count() and sorted(r[0] for r in replaced.where("category = 'atom_site'").select(categories.item("auth_asym_id")).collect()) == ["P", "Q", "R"]
    with pytest.raises(IndexError):
        categories.replace_item(rows, "atom_site", "auth_asym_id", "PQ")


def test_fit(spark):
    head = "path string, line_number int, serial int, chain_id string, residue_number int, insertion_code string, residue_name string, model int"
    atoms = spark.createDataFrame([("f", 1, 900000, "long", 12345, None, "G", 1), ("f", 2, 900001, "long", 12345, "A", "G", 1), ("f", 3, 900002, "B", 7, None, "C", 1), ("f", 4, 900003, "long", 12345, None, "G", 2)], head)
    assert [r.fits for r in structure.fits_pdb(atoms).collect()] == [False]
    out = structure.fit_to_pdb(atoms)
    assert [(r.serial, r.chain_id, r.residue_number) for r in out.orderBy("line_number").collect()] == [(1, "A", 1), (2, "A", 2), (4, "B", 1), (6, "A", 1)]
    assert structure.fits_pdb(out).first().fits
    many = spark.range(63).select(F.lit("f").alias("path"), F.col("id").cast("int").alias("line_number"), F.lit(1).alias("serial"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chain_id"), F.lit(1).alias("residue_number"), F.lit(None).cast("string").alias("insertion_code"), F.lit("G").alias("residue_name"), F.lit(1).alias("model"))
    with pytest.raises(ValueError):
        structure.fit_to_pdb(many)
