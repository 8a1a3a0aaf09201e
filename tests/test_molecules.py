"""Operators on atom tables and clustering against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe.functions import residues
from helixframe.operators import clusters, spatial, structure
from helixframe.sources import pdb
from helixframe.sources.pdb import read_pdb
from tests.fixtures import fixture

NAMES = ["P", "O5'", "C5'", "C4'", "C3'", "O3'", "O4'", "C1'", "N9", "C4"]


def make_atoms(spark, seed=0, chains="ABC", n=4):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for c, chain in enumerate(chains):
        at = np.array([40.0 * (c == 2), 0, 0])
        for number in range(1, n + 1):
            for name in NAMES:
                at = at + rng.normal(0, 0.6, 3)
                rows.append(("f", k, "ATOM", k + 1, name, None, "AGCU"[number % 4], chain, number, None, *map(float, at), float(rng.choice([0.5, 1.0])), 0.0, name[0], None, 1))
                k += 1
    return rows, spark.createDataFrame(rows, "path string, line_number int, record_type string, serial int, atom_name string, alt_loc string, residue_name string, chain_id string, residue_number int, insertion_code string, x double, y double, z double, occupancy double, b_factor double, element string, charge string, model int")


def test_contacts(spark):
    rows, atoms = make_atoms(spark)
    points = np.array([r[10:13] for r in rows])
    radius = np.array([residues.RADII[r[4][0]] for r in rows])
    got = {(r.id_1, r.id_2) for r in structure.clashes(atoms, 0.2).collect()}
    residue = [(r[7], r[8]) for r in rows]
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if residue[i] != residue[j] and np.linalg.norm(points[i] - points[j]) <= radius[i] + radius[j] + 0.2}
    assert got == want
    occupancy = [r[13] for r in rows]
    lost = {j if occupancy[i] > occupancy[j] else i for i, j in itertools.combinations(range(len(rows)), 2) if np.linalg.norm(points[i] - points[j]) <= 0.5}
    assert {r.line_number for r in structure.drop_overlapping(atoms).collect()} == set(range(len(rows))) - lost
    groups = {r.chain_id: r.group for r in structure.chain_groups(atoms).collect()}
    assert groups == {"A": "A", "B": "A", "C": "C"}


def test_torsions(spark):
    rows, atoms = make_atoms(spark, 3, "A", 3)
    table = structure.with_segments(structure.residue_table(atoms)).withColumn("segment", F.lit(1))
    got = {r.residue_number: r for r in structure.torsions(table).collect()}
    at = {(r[8], r[4]): np.array(r[10:13]) for r in rows}

    def angle(a, b, c, d):
        u, v, w = b - a, c - b, d - c
        return np.arctan2(np.linalg.norm(v) * u @ np.cross(v, w), np.cross(u, v) @ np.cross(v, w))

    assert got[1].alpha is None and got[3].zeta is None
    assert np.isclose(got[2].alpha, angle(at[1, "O3'"], at[2, "P"], at[2, "O5'"], at[2, "C5'"]))
    assert np.isclose(got[2].zeta, angle(at[2, "C3'"], at[2, "O3'"], at[3, "P"], at[3, "O5'"]))
    assert np.isclose(got[1].chi, angle(at[1, "O4'"], at[1, "C1'"], at[1, "N9"], at[1, "C4"]))


def test_filters_and_writer(spark, tmp_path):
    rows, atoms = make_atoms(spark, 1, "AB", 2)
    extra = [("f", 900, "HETATM", 901, "O", None, "HOH", "A", 50, None, 0.0, 0.0, 0.0, 1.0, 0.0, "O", None, 1), ("f", 901, "HETATM", 902, "MG", None, "MG", "A", 51, None, 0.0, 0.0, 0.0, 1.0, 0.0, "MG", None, 2)]
    both = atoms.unionByName(spark.createDataFrame(extra, atoms.schema))
    assert structure.keep_polymers(both).count() == len(rows)
    assert structure.keep_polymers(both, nucleic=False, water=True, ions=True).count() == 2
    assert structure.select_model(both, 2).count() == 1 and structure.select_model(both, 7).count() == len(rows) + 1
    content = structure.pdb_documents(both).first().content
    assert content.count("TER") == 4 and content.count("MODEL") == 2 and content.endswith("ENDMDL\nEND\n")
    (tmp_path / "y.pdb").write_text(content)
    assert pdb.read_pdb(spark, str(tmp_path)).select("serial", "model").exceptAll(both.select("serial", "model")).count() == 0
    assert structure.best_atoms(both.unionByName(both)).count() == len(rows) + 2


def test_superposition(spark):
    rng = np.random.default_rng(2)
    p = rng.standard_normal((9, 3))
    turn, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    assert structure.rmsd(p, p @ turn.T + 5) < 1e-6
    q = rng.standard_normal((9, 3))
    a, b = p - p.mean(axis=0), q - q.mean(axis=0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    want = np.sqrt(((a * a).sum() + (b * b).sum() - 2 * s.sum()) / 9)
    assert np.isclose(structure.rmsd(p, q), want)
    df = spark.createDataFrame([("x", "y", a.tolist(), b.tolist()) for a, b in zip(p, q)], "a string, b string, p array<double>, q array<double>")
    assert np.isclose(structure.nrmsd_pairs(df).first().nrmsd, want / 3)


def test_clustering(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (7, 5)) for c in (0, 3, 6)])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = clusters.distance_matrix(spatial.pair_distances(vectors, 8), list(range(21)))
    assert np.allclose(d, np.linalg.norm(x[:, None] - x[None], axis=2))
    merges = clusters.complete_linkage(d)
    assert clusters.cut(merges, 21, 1.5) == [0] * 7 + [1] * 7 + [2] * 7 and len(set(clusters.cut(merges, 21, 0))) == 21
    for cutoff in (0.2, 0.3):  # no two clusters within the cutoff, none wider
        labels = np.array(clusters.cut(merges, 21, cutoff))
        assert all(d[np.ix_(labels == k, labels == k)].max() <= cutoff for k in set(labels))
        assert all(d[np.ix_(labels == k, labels == m)].max() > cutoff for k, m in itertools.combinations(set(labels), 2))
    exemplars = clusters.affinity_propagation(d)
    assert [len({e // 7 for e in exemplars[k : k + 7]}) for k in (0, 7, 14)] == [1, 1, 1]
    picks, gains = clusters.facility_location(np.where(np.eye(21, dtype=bool), 0, d.max() - d), 3)
    assert gains == sorted(gains, reverse=True) and picks[0] == int(np.argmax(np.where(np.eye(21, dtype=bool), 0, d.max() - d).sum(axis=1)))
    mean, axes = clusters.principal_axes(vectors, 0.95)
    centred = x - x.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2
    assert len(axes) == int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    assert np.isclose(((centred @ axes.T) ** 2).sum(), values[: len(axes)].sum())


@pytest.mark.skipif(not fixture("R1107TS128_4.pdb"), reason="set HELIXFRAME_FIXTURES to a folder with the CASP model R1107TS128_4")
@pytest.mark.parametrize("margin,lines", [(0.0, 48), (0.5, 1767)])
def test_published_clashes(spark, margin, lines):
    """The published numbers count the lines of a report: chain pairs, residue pairs and atom pairs."""
    atoms = read_pdb(spark, fixture("R1107TS128_4.pdb"))
    found = structure.clashes(atoms, margin, same_residue=True)
    assert structure.clash_report(found, structure.with_residues(atoms)).count() == lines


def test_occupancies(spark):
    base = dict(path="f", model=1, chain_id="A", residue_name="A", y=0.0, z=0.0)
    rows = [("C1'", 1, 0.0, 0.5), ("C1'", 2, 1.0, 0.5), ("N1", 2, 1.1, None), ("C2", 3, 40.0, 0.7), ("C2", 3, 40.0, 0.7), ("C4", 3, 40.2, 0.9), ("C5", 3, 60.0, None), ("C6", 3, 60.1, 0.1)]
    atoms = spark.createDataFrame([Row(line_number=k, atom_name=n, residue_number=r, x=x, occupancy=o, **base) for k, (n, r, x, o) in enumerate(rows)]).withColumn("insertion_code", F.lit(None).cast("string"))
    pairs = lambda **kw: sorted((r.id_1, r.id_2) for r in structure.clashes(atoms, **kw).collect())
    assert (0, 1) in pairs() and (0, 2) in pairs() and (1, 2) not in pairs() and (1, 2) in pairs(same_residue=True)
    assert pairs(any_occupancy=False, same_residue=True) == [(0, 1)] and pairs(same_name=True) == [(0, 1)]
    # repeated atoms go, the lesser of two near atoms goes, and a null occupancy decides nothing
    assert sorted(r.line_number for r in structure.drop_overlapping(atoms).collect()) == [0, 1, 2, 5, 6, 7]


def test_wide_lines(spark):
    names = "serial long, number long, x double"
    rows = [(99_999, 9_999, 1.0), (100_000, 10_000, -999.999), (43_770_016, 700_000, 0.0), (1, 1, 12345.678), (90_000_000, 1, 0.0), (2, None, 0.5)]
    lit = F.lit
    line = pdb.atom_line(record=lit("ATOM"), serial=F.col("serial"), name=lit("P"), alt=lit(None), residue=lit("A"), chain=lit("A"), number=F.col("number"), icode=lit(None), x=F.col("x"), y=lit(0.0), z=lit(0.0), occupancy=lit(1.0), b=lit(0.0), element=lit("P"), charge=lit(None))
    lines = spark.createDataFrame(rows, names).select("serial", "number", "x", line.alias("value"), lit("f").alias("path"), lit(0).alias("line_number"))
    assert [r.serial for r in lines.where("value is null").orderBy("serial").collect()] == [1, 90_000_000]
    assert lines.where("length(value) <> 80").count() == 0
    back = pdb.parse_atom_lines(lines.where("value is not null").withColumnsRenamed({"serial": "want", "number": "wanted", "x": "at"}))
    assert back.where("serial <> want or not residue_number <=> wanted or x <> at").count() == 0 and back.count() == 4
