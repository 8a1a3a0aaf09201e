"""Planes, superposition, scoring, radius graphs and knees against numpy and brute force."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import chemistry
from helixframe.operators import clusters, distill, interactions, planes, scoring, spatial, superpose
from tests.fixtures import fixture

RING = {"N9": (0.0, 0.0), "C4": (1.3, 0.4), "C5": (1.3, 1.8), "N7": (0.0, 2.2), "C8": (-0.8, 1.1), "C6": (2.5, 2.5), "N1": (3.6, 1.8), "C2": (3.6, 0.4), "N3": (2.5, -0.3)}


def base(shift, turn=0.0, flip=False, letter="A"):
    c, s = math.cos(turn), math.sin(turn)
    out = {}
    for n, (x, y) in RING.items():
        y = -y if flip else y
        out[n] = [c * x - s * y + shift[0], s * x + c * y + shift[1], float(shift[2])]
    return out | {"C1'": [out["N9"][0] - 1, out["N9"][1] - 1, out["N9"][2]]}


def test_planes_and_stacking(spark):
    table = spark.createDataFrame([(1, "A", base((0, 0, 0))), (2, "G", base((0.5, 0, 3.4), 0.3)), (3, "A", base((0, 0.2, -3.3), 0.1, True)), (4, "A", base((30, 0, 0.1))), (5, "x", base((0, 0, 0))), (6, "A", {"N9": [0.0, 0.0, 0.0]})], "residue int, letter string, atoms map<string,array<double>>")
    found = planes.base_planes(table).cache()
    got = {r.residue: r for r in found.collect()}
    assert sorted(got) == [1, 2, 3, 4, 6] and got[6].normal is None
    assert np.allclose(got[1].normal, [0, 0, 1]) and np.allclose(got[3].normal, [0, 0, -1])
    sides = [found.select(*[F.col(c).alias(f"{c}_{k}") for c in ("residue", "core", "centroid", "normal")]) for k in (1, 2)]
    pairs = sides[0].join(sides[1], F.col("residue_1") < F.col("residue_2"))
    out = {(r.residue_1, r.residue_2): r for r in planes.stacking_parameters(pairs).collect()}
    one, two = out[1, 2], out[1, 3]
    assert math.isclose(one.inter_planar, 3.4) and one.face == "Same" and two.face == "Opposite" and one.valid and abs(one.dihedral) < 1e-3
    core = np.array([RING[n] for n in chemistry.PURINE_CORE])
    full = planes.clipped_area(planes.hull(core), planes.hull(core))
    assert 5 < one.overlap < full and out[1, 4].overlap == 0.0 and not out[1, 4].valid
    groups = found.select(F.when(F.col("residue") == 3, "far").when(F.col("residue") == 6, "thin").otherwise("flat").alias("g"), "core", "residue")
    groups = groups.where("residue <> 2").unionByName(groups.where("residue in (1)").withColumn("g", F.lit("far"))).unionByName(groups.where("residue = 1").withColumn("g", F.lit("thin")))
    assert dict(map(tuple, planes.coplanar(groups, ["g"]).collect())) == {"flat": True, "far": False, "thin": None}


def test_areas_against_sampling():
    rng = np.random.default_rng(3)
    for _ in range(20):
        one, two = (planes.hull(rng.normal(size=(9, 2)) + s) for s in (0, rng.normal(size=2)))
        dots = rng.uniform(-4, 5, (40_000, 2))
        inside = lambda h: np.all([(b[0] - a[0]) * (dots[:, 1] - a[1]) - (b[1] - a[1]) * (dots[:, 0] - a[0]) >= 0 for a, b in zip(h, np.roll(h, -1, axis=0))], axis=0)  # noqa: B023, E731
        assert abs(planes.clipped_area(one, two) - (inside(one) & inside(two)).mean() * 81) < 0.4


def test_bonds_and_edges(spark):
    pair = {"N6": [0.0, 0.0, 0.0], "C6": [-1.3, 0.0, 0.0], "N1": [0.0, -3.0, 0.0]}, {"O4": [2.9, 0.0, 0.0], "C4": [4.1, 0.0, 0.0], "N3": [0.0, -5.8, 0.0], "C2": [0.0, -7.0, 0.0]}
    table = spark.createDataFrame([("f", 1, "A", pair[0]), ("f", 2, "U", pair[1])], "path string, residue int, letter string, atoms map<string,array<double>>")
    pairs = spark.createDataFrame([("f", 1, 2)], "path string, residue_1 int, residue_2 int")
    bonds = planes.hbond_parameters(planes.hbond_candidates(pairs, table, ["path"]))
    valid = sorted((r.donor, r.acceptor) for r in bonds.where("valid").collect())
    assert valid == [("N3", "N1"), ("N6", "O4")] and bonds.count() == 1 * 1 + 1 * 1
    counts = sorted(tuple(r)[1:] for r in planes.edge_counts(bonds, ["path"]).collect())
    assert counts == [(1, "Hoogsteen", 1), (1, "Watson-Crick", 2), (2, "Hoogsteen", 1), (2, "Watson-Crick", 2)]
    text = "[hbonds]\ndonor_acceptor_distance_min = 2.5\ndonor_acceptor_distance_max = 3.5\n"
    assert planes.read_thresholds(text) == {"hbonds": {"donor_acceptor_distance": (2.5, 3.5)}}


def test_superposition_methods(spark):
    rng = np.random.default_rng(1)
    for n in (3, 10, 60):
        p = rng.normal(size=(n, 3))
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))
        assert superpose.nrmsd(p, p @ turn + 5, "svd") < 1e-7
        q = p @ turn + rng.normal(size=(n, 3)) * 0.3
        values = [superpose.nrmsd(p, q, m) for m in (*superpose.METHODS, "validate")]
        assert max(values) - min(values) < 1e-9
        assert n == 3 or superpose.rmsd_svd(p, p * [1, 1, -1]) > 0.01  # a mirror image is no fit
    rows = [(s, k, name, {a: rng.normal(size=3).tolist() for a in chemistry.TEMPLATES[name]}) for s, names in (("x", ("A", "C", "G")), ("y", ("G", "DC", "U")), ("z", ("A", "C", "G"))) for k, name in enumerate(names)]
    residues = spark.createDataFrame(rows, "id string, place int, residue_name string, atoms map<string,array<double>>")
    points = superpose.paired_coordinates(spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string"), residues)
    sizes = {(r.a, r.b): r for r in superpose.nrmsd_of(points).collect()}
    assert sizes["x", "z"].n == sum(len(chemistry.TEMPLATES[n]) for n in "ACG")
    assert sizes["x", "y"].n == 10 + 9 + 9 + 6 + 10  # purines, pyrimidines with DNA, backbone only


def test_statistics_of_angles(spark):
    rng = np.random.default_rng(4)
    x = rng.vonmises(0.5, 4, 101)
    median = scoring.circular_median(x)
    sums = [np.abs(np.angle(np.exp(1j * (v - x)))).sum() for v in x]
    assert math.isclose(np.abs(np.angle(np.exp(1j * (median - x)))).sum(), min(sums))
    assert scoring.wilcoxon(np.arange(1.0, 6)) == 0.0625 and scoring.wilcoxon(np.array([])) == 1.0
    signs = np.array(list(itertools.product([-1, 1], repeat=7)))
    data = np.array([1.5, -2, 3, 4, -5.5, 6, 7])
    ranks = np.argsort(np.argsort(np.abs(data))) + 1
    plus = (signs > 0) @ np.sort(ranks)
    seen = min(ranks[data > 0].sum(), ranks[data < 0].sum())
    assert math.isclose(scoring.wilcoxon(data), min(1.0, 2 * (plus <= seen).mean()))
    assert scoring.rayleigh(rng.uniform(-math.pi, math.pi, 300)) > 0.01 > scoring.rayleigh(x) and scoring.watson(x) < 0.01 < scoring.watson(rng.uniform(-math.pi, math.pi, 300))
    low, high = scoring.bootstrap(x, scoring.circular_mean, 500, np.random.default_rng(0))
    assert low < scoring.circular_mean(x) < high
    angles = ", ".join(f"{a} double" for a in scoring.ANGLES)
    schema = f"path string, residue int, chain_id string, residue_number int, residue_name string, {angles}"
    target = [("t", k, "A", k, "G", *map(float, rng.uniform(-3, 3, 7))) for k in range(12)]
    models = [("same", *r[1:]) for r in target] + [("near", *r[1:5], *[a + 0.1 for a in r[5:]]) for r in target] + [("wild", *r[1:5], *map(float, rng.uniform(-3, 3, 7))) for r in target] + [("other", 0, "B", 0, "G", *[0.0] * 7)]
    models.append(("near", 0, "A", 3, "G", *[0.0] * 7))  # an earlier residue with the same key does not count
    found = scoring.torsion_differences(spark.createDataFrame(target, schema), spark.createDataFrame(models, schema))
    scores = {r.path: r for r in scoring.evaluate(found, rounds=60).collect()}
    assert set(scores) == {"same", "near", "wild"} and scores["near"].n == 84 and math.isclose(scores["near"].mcq, 0.1)
    assert scores["same"].score > scores["near"].score > scores["wild"].score and scores["same"].mcq < 1e-12


def test_knees_and_fits():
    x = np.linspace(0, 10, 30)
    for a, b, c in ((50, 0.7, 3), (10, 0.35, 1), (200, 1.5, 0)):
        assert np.allclose(distill.fit_decay(x, distill.decay(x, a, b, c)), (a, b, c), rtol=1e-5, atol=1e-5)
        found = distill.knees(x, distill.decay(x, a, b, c))
        assert (math.isclose(found[0], 1 / b, rel_tol=1e-5) if 1 / b >= 1 else found and found[0] >= 1)
    assert distill.knees(x[:3], x[:3]) == [] and distill.best_value(x[:3], x[:3], 7.0) == 7.0


def test_radius_graph(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(15, 3)) * 0.1 + c for c in ((0, 0, 0), (5, 0, 0), (0, 7, 0))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    edges = spatial.nearest_edges(df, 4, block=20).cache()
    plain = spatial.knn_edges(spatial.pair_distances(df), 4)
    rounded = lambda e: sorted((r.a, r.b, round(r.d, 9)) for r in e.collect())
    assert rounded(edges) == rounded(plain)
    known = [(r.a, r.b, r.d) for r in edges.collect()]

    def components(radius):
        parent = list(range(len(x)))

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for a, b, d in known:
            if d <= radius:
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        return [find(k) for k in range(len(x))]

    curve = {r.value: r.n_clusters for r in distill.radius_candidates(edges, len(x)).collect()}
    assert all(n == len(set(components(v))) for v, n in curve.items()) and set(curve) == {d for *_, d in known}
    assert distill.minimum_forest(edges, fan=2, part_rows=20).count() == len(x) - len(set(components(math.inf)))
    groups, radius = distill.approximate_clusters(df, 4)
    assert [r.group for r in groups.orderBy("id").collect()] == components(radius)
    pairs = spatial.pair_distances(df)
    labels, cutoff = distill.exact_clusters(pairs, list(range(len(x))), 2.0)
    assert labels == sorted(labels) and len(set(labels)) == 3 and cutoff == 2.0
    assert distill.exact_clusters(pairs, [0]) == ([0], 0.0)
    d = clusters.distance_matrix(pairs, list(range(len(x))))
    merges = clusters.complete_linkage(d)
    best, scores = distill.best_cutoff(merges, d)
    assert len(set(clusters.cut(merges, len(x), best))) == 3 and max(e["silhouette_score"] for e in scores) > 0.9
    order = distill.leaf_order(merges, len(x))
    assert sorted(order) == list(range(len(x))) and len({labels[k] for k in order[:15]}) == 1
    assert distill.cut_counts(merges, len(x))[-1][1] == 1
    near = {r.id: (r.rep, round(r.d, 6)) for r in spatial.nearest(df, df.where("id % 20 = 3").select(F.col("id").alias("rep"), F.col("v").alias("w")), block=10).collect()}
    assert all(near[k] == min((round(float(d[k, r]), 6), r) for r in (3, 23, 43))[::-1] for k in range(len(x)))


def test_facility_location_is_lazy():
    rng = np.random.default_rng(6)
    for n in (4, 30):
        d = np.linalg.norm(rng.normal(size=(n, 1, 3)) - rng.normal(size=(1, n, 3)), axis=2)
        d = d + d.T
        s = d.max() - d
        np.fill_diagonal(s, 0)
        picks, gains = clusters.facility_location(s, n)
        lazy, lazy_gains = distill.lazy_greedy(s, n)
        assert lazy == picks and np.allclose(gains, lazy_gains)
        sparse = [{j: float(s[k, j]) for j in range(n)} for k in range(n)]
        assert distill.lazy_greedy_sparse(sparse, n)[0] == picks
        count, _ = distill.best_count(d * (1 - np.eye(n)), picks)
        assert count is None or 2 <= count < n


def test_features(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(3, 4, 3))
    points[2, 1] = np.nan
    got = distill.pair_features(points).reshape(3, 34)
    assert got.shape == (3, 34) and math.isclose(got[0, 5], np.linalg.norm(points[0, 1] - points[1, 1]), rel_tol=1e-6)
    assert got[1, 1] == 0 and tuple(got[1, 16:18]) == (0.0, 1.0) and np.allclose(got[0, 16:] .reshape(9, 2) ** 2 @ [1, 1], 1, atol=1e-5)
    a, b, c, d = points[0, 0], points[0, 1], points[1, 1], points[1, 0]
    left, right = np.cross(b - a, c - b), np.cross(c - b, d - c)
    turn = -np.arctan2(np.linalg.norm(c - b) * (b - a) @ right, left @ right)
    assert np.allclose(got[0, 16:18], [np.sin(turn), np.cos(turn)], atol=1e-5)
    rows = [("s", k, "A", {n: p.tolist() for n, p in zip(distill.PURINE_FOUR, points[k]) if not np.isnan(p).any()}) for k in range(3)]
    df = spark.createDataFrame(rows, "id string, place int, residue_name string, atoms map<string,array<double>>")
    assert np.allclose(distill.featurize(df).first().v, distill.pair_features(points))


def test_options_and_texts():
    distill.check_options(exact=True, method="hierarchical", threshold=0.1)
    for bad in (dict(exact=True, method="radius-graph"), dict(exact=False, method="hierarchical", threshold=0.1), dict(exact=True, method="hierarchical", radius=1.0), dict(exact=True, method="hierarchical", count=3), dict(exact=False, method="radius-graph", neighbours=0)):
        with pytest.raises(ValueError):
            distill.check_options(**bad)
    records = [{"representative": "b", "members": []}, {"representative": "a", "members": ["c", "d"]}]
    out = json.loads(distill.clustering_json(records, mode="exact", method="hierarchical", metric="nrmsd", selection={"value": 1.0}))
    assert out["clustering"]["cluster_sizes"] == [3, 1] and out["parameters"]["n_structures"] == 4 and len(distill.summary_lines(records)) == 3


@pytest.mark.skipif(not fixture("1ehz*.cif"), reason="set HELIXFRAME_FIXTURES to a folder with PDB entry 1EHZ")
def test_interactions_of_a_structure(spark):
    from helixframe.sources.cif import read_atoms, standard_names

    path = fixture("1ehz*.cif")
    atoms = read_atoms(spark, path).withColumnRenamed("row_idx", "line_number")
    table, found = interactions.interactions(atoms, standards=standard_names(spark, path))
    found = interactions.named(found, table).cache()
    pairs = {(r.nt_1, r.nt_2): r for r in found.where("kind = 'base-pair'").collect()}
    assert pairs["A.G1", "A.C72"].lw == "cWW" and pairs["A.G1", "A.C72"].saenger == "XIX" and pairs["A.G4", "A.U69"].saenger == "XXVIII"
    kinds = {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["base-pair"] >= 25 and kinds["stacking"] >= 40 and kinds["base-phosphate"] >= 3 and kinds["base-ribose"] >= 1
    rows = interactions.csv_rows(found)
    assert rows.columns == ["path", "nt1", "nt2", "type", "classification-1", "classification-2"] and rows.count() == found.count()
    document = json.loads(interactions.json_documents(found).first().content)
    assert len(document["base_pair"]) == kinds["base-pair"] and document["base_phosphate"][0]["code"].endswith("BPh")
    placed = interactions.gapped_places(interactions.connected(table.where("chain_id = 'A'")).select("path", "residue", "chain_id", "residue_number", "connected", "letter"))
    strands = interactions.strand_sequences(placed).collect()
    assert len(strands) == 1 and strands[0].sequence.startswith("GCGGAUUUA") and len(strands[0].sequence) == 76
    rank = interactions.pair_rank(F.lit("A"), F.lit("U"), F.col("saenger"))
    canonical = found.where("kind = 'base-pair' and lw = 'cWW'").select("path", F.least("residue_1", "residue_2").alias("residue_1"), F.greatest("residue_1", "residue_2").alias("residue_2"), "lw", rank.alias("rank"))
    kept = interactions.prune_conflicts(canonical)
    bpseq = {r.i: r for r in interactions.bpseq_with_gaps(placed, kept).collect()}
    assert (bpseq[1].base, bpseq[1].pair, bpseq[72].pair) == ("G", 72, 1)
    layers = interactions.extended_dot_bracket(placed, found.where("kind = 'base-pair'")).where("lw = 'cWW' and row = 1").first()
    assert layers.structure.startswith("(((((((") and len(layers.structure) == 76
