"""Files of any format, filters, unification, text forms, all orders, and the stream of new files."""

import itertools

import pytest
from pyspark.sql import functions as F

from helixframe.operators import secondary, texts
from helixframe.sources import cif, pdb, structures
from helixframe.streaming import incremental

PDB = """HEADER    X
MODEL        1
ATOM      1  P     A A   1       0.000   0.000   0.000  1.00  0.00           P
HETATM    2  O   HOH A   2       1.000   0.000   0.000  1.00  0.00           O
ENDMDL
MODEL        2
ATOM      1  P     A A   1       0.000   0.000   1.000  1.00  0.00           P
ENDMDL
END
"""
CIF = """data_
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.auth_atom_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 "C1'" A A 1 0.0 0.0 0.0
ATOM 2 P A B 2 1.0 0.0 0.0
#
_struct.entry_id X
_struct.title 'a title'
"""


def test_structures(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    (tmp_path / "b.cif").write_text(CIF)
    with pytest.raises(ValueError):
        structures.read_structures(spark, [str(tmp_path / "c.txt")])
    atoms = structures.read_structures(spark, [str(tmp_path / "a.pdb"), str(tmp_path / "b.cif")])
    assert atoms.count() == 5 and {r.atom_name for r in atoms.where("path like '%cif'").collect()} == {"C1'", "P"}
    kinds = spark.createDataFrame([(PDB,), (CIF,)], "t string").select(structures.format_of(F.col("t")).alias("f"), structures.normalised_cif(F.col("t")).alias("n")).collect()
    assert [k.f for k in kinds] == ["pdb", "mmcif"] and kinds[1].n.startswith("data_structure\n")
    lines = pdb.scan_lines(spark, str(tmp_path / "a.pdb"))
    dry = pdb.read_pdb(spark, str(tmp_path / "a.pdb")).where("residue_name <> 'HOH'")
    assert structures.line_documents(structures.filter_lines(lines, dry)).first().content == "\n".join(x for x in PDB.split("\n") if "HOH" not in x)
    models = {r.model: r.content for r in structures.model_documents(pdb.read_pdb(spark, str(tmp_path / "a.pdb"))).collect()}
    assert set(models) == {1, 2} and "HOH" in models[1] and "HOH" not in models[2]
    rows = cif.read_categories(spark, str(tmp_path / "b.cif"))
    kept = structures.filter_site(rows, rows.where("category = 'atom_site' and attrs['auth_asym_id'] = 'B'"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "c.cif").write_text(structures.cif_documents(kept).first().content)
    back = cif.read_categories(spark, str(tmp_path / "out"))
    assert [(r.category, r.attrs.get("auth_asym_id"), r.attrs.get("title")) for r in back.orderBy("category").collect()] == [("atom_site", "B", None), ("struct", None, "a title")]
    assert structures.category_rows(rows, []).where("item = 'title'").first().value == "a title"
    structures.write_categories(rows, ["atom_site"], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv" / "atom_site"), header=True).count() == 2


def test_unify(spark, tmp_path):
    (tmp_path / "component_A.csv").write_text("atom_id,alt_atom_id\nP,P\nOP1,O1P\nN9,N9\nH1,H1\n")
    components = structures.read_components(spark, str(tmp_path))
    schema = "id string, residue int, residue_name string, chain_id string, residue_number int, insertion_code string, atom_name string"
    rows = []
    for k, (chain, names) in enumerate((("X", ("N9", "O1P", "P", "H1")), ("Y", ("P", "OP1", "N9")), ("Y", ("P", "OP1", "N9", "Q")))):
        rows += [(f"s{k}", 1, "A", chain, 7, None, n) for n in names] + [(f"s{k}", 2, "HOH", "W", 1, None, "O")]
        rows += [(f"s{k}", 3, "A", chain, 8, None, n) for n in names[: 2 + (k == 1)]]
    out = structures.unify(spark.createDataFrame(rows, schema), components)
    got = {s: [r.atom_name for r in out.where(F.col("id") == s).orderBy("residue", "place").collect()] for s in ("s0", "s1", "s2")}
    assert got == dict.fromkeys(("s0", "s1", "s2"), ["P", "OP1", "N9"]) and {r.chain_id for r in out.collect()} == {"Y"}
    with pytest.raises(ValueError):
        structures.unify(spark.createDataFrame(rows + [("s0", 4, "A", "X", 9, None, "P")], schema), components)


def test_texts(spark):
    rows = spark.createDataFrame([("a", "GGGAAACCCU", "(((...)))."), ("k", "GGGAACCCAAUUGG", "(((..[[)))..]]")], "id string, sequence string, structure string")
    bpseq = secondary.bpseq_of(rows)
    lines = texts.element_lines(secondary.elements_of(bpseq), rows)
    got = {r.text for r in lines.where("id = 'a'").collect()}
    assert got == {"Stem 1 3 GGG ((( 7 9 CCC )))", "Hairpin 3 7 GAAAC (...)", "SingleStrand3p 9 10 CU )."}
    dot = texts.element_graph(lines).where("id = 'a'").first().content
    assert dot.count("--") == 2 and dot.count("label") == 3
    ordered = secondary.orders_first_come(secondary.pairs_of(rows))
    plain, knots = texts.decompose(bpseq.where("id = 'k'"), ordered.where("id = 'k'"))
    assert sorted(r.kind for r in plain.collect()) == ["3'", "hairpin", "stem"] and [(r.i, r.j, r.length) for r in knots.collect()] == [(6, 14, 2)]
    assert [tuple(r)[1:] for r in texts.stem_rows(secondary.elements_of(bpseq.where("id = 'a'"))).collect()] == [(0, 1, 3, 7, 9, 3)]
    stems = spark.createDataFrame([("a", 0, "A", 1, 3, "B", 7, 9, [[float(k), 0.0, 0.0] for k in range(4)]), ("a", 1, "A", 11, 11, "B", 17, 17, [[0.0, 0.0, 0.0]])], "id string, stem int, chain_5p string, first_5p int, last_5p int, chain_3p string, first_3p int, last_3p int, centroids array<array<double>>")
    script = texts.stem_script(stems).first().content.split("\n")
    assert script[0] == "select stem0, A/1-3/ or B/7-9/" and len(script) == 1 + 4 + 3 + 1 + 1 and script[-1].startswith("select stem1")
    held = texts.strand_residues(spark.createDataFrame([("a", 2, 4)], "id string, first int, last int"), spark.createDataFrame([("a", k, f"r{k}") for k in range(1, 9)], "id string, place int, residue string"))
    assert sorted(r.residue for r in held.collect()) == ["r2", "r3", "r4"]


def test_all_orders(spark):
    stems = [(1, 20, 3), (5, 30, 2), (15, 40, 2), (50, 60, 1), (70, 90, 1), (80, 95, 1)]
    crossing = lambda a, b: a[0] < b[0] < a[1] < b[1] or b[0] < a[0] < b[1] < a[1]
    got = texts.all_orders(stems)
    assert len(got) == len({tuple(x) for x in got}) > 2
    for orders in got:
        for (a, x), (b, y) in itertools.combinations(zip(stems, orders), 2):
            assert not (crossing(a, b) and x == y)
        for a, x in zip(stems, orders):  # each order is the lowest that a crossing stem leaves, in some sequence
            assert {y for b, y in zip(stems, orders) if crossing(a, b)} >= set(range(x))
    assert texts.all_orders([(1, 5, 2), (7, 9, 1)]) == [[0, 0]]
    with pytest.raises(ValueError):
        texts.all_orders([(k, k + 50, 1) for k in range(1, 10)])
    df = spark.createDataFrame([("a", *s) for s in stems], "id string, i int, j int, length int")
    assert texts.all_orders_of(df).select("solution").distinct().count() == len(got)


def test_stream(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdb").write_text(PDB)
    run = lambda: incremental.append_results(incremental.stream_atoms(spark, folder), incremental.atom_counts, table, checkpoint).awaitTermination()
    run()
    (tmp_path / "in" / "b.pdb").write_text(PDB)
    run()
    run()
    got = [(r.path.rsplit("/", 1)[1], r.n_atoms) for r in spark.read.parquet(table).orderBy("path").collect()]
    assert got == [("a.pdb", 2), ("b.pdb", 2)]


def test_site_documents(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    atoms = pdb.read_pdb(spark, str(tmp_path / "a.pdb"))
    (tmp_path / "b.cif").write_text(cif.site_documents(atoms).first().content)
    back = cif.read_atoms(spark, str(tmp_path / "b.cif"))
    columns = ["record_type", "serial", "atom_name", "alt_loc", "residue_name", "chain_id", "residue_number", "x", "y", "z", "model"]
    assert sorted(map(tuple, back.select(*columns).collect()), key=str) == sorted(map(tuple, atoms.select(*columns).collect()), key=str)
    rows = cif.read_categories(spark, str(tmp_path / "b.cif"))
    assert cif.missing_ids(rows).count() == 0
    bad = rows.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.endswith("seq_id")))
    assert [r.what for r in cif.missing_ids(bad).collect()] == ["number"] * 3


def test_documents_and_anchors(spark, tmp_path):
    from helixframe.operators import distill, structure

    (tmp_path / "a.pdb").write_text(PDB)
    atoms = pdb.read_pdb(spark, str(tmp_path / "a.pdb"))
    ends = [x for x in structure.pdb_documents(atoms).first().content.split("\n") if x.startswith("TER")]
    assert [x.rstrip() for x in ends] == ["TER       3      HOH A   2", "TER       2        A A   1"] and all(len(x) == 80 for x in ends)
    chosen = structure.anchors_of(atoms.withColumn("atom_name", F.lit("C1'")))
    assert chosen.count() == 2 and structure.anchors_of(atoms.withColumns({"atom_name": F.lit("C1'"), "residue_name": F.lit("ALA")})).count() == 0
    assert structure.by_chains(atoms, ["A"], [2]).count() == 1 and structure.by_chains(atoms, ["B"]).count() == 0
    table = spark.createDataFrame([("f", "1", {"P": [0.0] * 3}), ("f", "2", {"P": [0.0] * 3}), ("g", "1", {"P": [0.0] * 3})], "path string, entity string, atoms map<string,array<double>>")
    kinds = spark.createDataFrame([("f", "1", True), ("f", "2", False)], "path string, entity string, is_nucleic boolean")
    assert [(r.path, r.entity) for r in structure.nucleic_only(table, kinds).collect()] == [("f", "1")] and structure.nucleic_only(table).count() == 0
    import numpy as np

    x = np.array([0, 0.1, 0.2, 9, 9.1, 9.3])
    picks, nearest = distill.facility_clusters(np.abs(x[:, None] - x[None, :]), 2)
    assert len(picks) == 2 and len(set(nearest[:3])) == len(set(nearest[3:])) == 1 and nearest[0] != nearest[5]
    assert len(distill.facility_clusters(np.abs(x[:, None] - x[None, :]))[0]) >= 1
