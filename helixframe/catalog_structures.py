"""More registered queries of the structure engine: residues, pairs, brackets, strands, adapters and scores.

Letters, names, edges and points are made from the columns of the tables at hand, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.catalog import _POINTS, _TORSION, _as_category, _cross_sql, _point, _read, _vectors, query
from helixframe.functions import chemistry, geometry, residues
from helixframe.operators import annotate, categories, distill, interactions, planes, scoring, secondary, stems, structure, superpose
from helixframe.sources import annotations, tools
from helixframe.sources.secondary import bpseq_line

def _none() -> Column:
    return F.lit(None).cast("string")


def _listed(values: tuple[str, ...]) -> str:
    """A SQL list of texts, for Spark and DuckDB."""
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _pick(values: tuple[str, ...], index: str) -> str:
    """CASE that picks a text by a number from 0, for Spark and DuckDB."""
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(quoted)) + " END"


# -- bases and pairs ------------------------------------------------------------------------------------------------
_ONE, _TWO, _LW = _pick(tuple("ACGUT"), "l_partkey % 5"), _pick(tuple("ACGUT"), "l_suppkey % 5"), _pick(chemistry.SCORED, "(l_linenumber + l_partkey) % 18")
_PAIRS = f"SELECT l_orderkey, l_linenumber, {_ONE} AS one, {_TWO} AS two, {_LW} AS lw FROM lineitem"


def _pairs(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_ONE} AS one", f"{_TWO} AS two", f"{_LW} AS lw")


_SAENGER = ", ".join(f"('{k}', '{v}')" for k, v in chemistry.SAENGER.items())


@query(f"WITH p AS ({_PAIRS}) SELECT l_orderkey, l_linenumber, s FROM p LEFT JOIN (VALUES {_SAENGER}) t(k, s) ON k = one || two || ' ' || lw")
def saenger_class(spark, sf_dir):
    return _pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", chemistry.saenger(F.col("one"), F.col("two"), F.col("lw")).alias("s"))


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT p.*, s FROM p LEFT JOIN (VALUES {_SAENGER}) t(k, s) ON k = one || two || ' ' || lw)
    SELECT l_orderkey, l_linenumber, CASE WHEN s IS NOT NULL THEN s IN ('XIX', 'XX', 'XXVIII') ELSE lw = 'cWW' AND least(one, two) || greatest(one, two) IN ('AU', 'AT', 'CG', 'GU') END AS canonical FROM s""")
def canonical_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    s = chemistry.saenger(F.col("one"), F.col("two"), F.col("lw"))
    return p.select("l_orderkey", "l_linenumber", chemistry.is_canonical(F.col("one"), F.col("two"), F.col("lw"), s).alias("canonical"))


@query(f"SELECT l_orderkey, l_linenumber, lw[1] || lw[3] || lw[2] AS reverse, score FROM (SELECT l_orderkey, l_linenumber, {_LW} AS lw, CAST((l_linenumber + l_partkey) % 18 + 1 AS INTEGER) AS score FROM lineitem)")
def pair_reverse_and_score(spark, sf_dir):
    return _pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", chemistry.reverse_lw(F.col("lw")).alias("reverse"), chemistry.pair_score(F.col("lw")).alias("score"))


_TOPOLOGY = _pick(("upward", "downward", "inward", "outward"), "event_id % 4")


@query(f"WITH e AS (SELECT event_id, {_TOPOLOGY} AS t FROM events) SELECT event_id, CASE t WHEN 'upward' THEN 'downward' WHEN 'downward' THEN 'upward' ELSE t END AS topology FROM e")
def stacking_reverse(spark, sf_dir):
    return _read(spark, sf_dir, "events").selectExpr("event_id", f"{_TOPOLOGY} AS t").select("event_id", chemistry.reverse_topology(F.col("t")).alias("topology"))


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT p.*, s FROM p LEFT JOIN (VALUES {_SAENGER}) t(k, s) ON k = one || two || ' ' || lw)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN s IS NULL THEN CASE WHEN least(one, two) || greatest(one, two) IN ('AU', 'AT', 'CG') THEN 0 WHEN least(one, two) || greatest(one, two) IN ('GU', 'GT') THEN 1 ELSE 2 END
        WHEN s IN ('XIX', 'XX') THEN 0 WHEN s = 'XXVIII' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM s""")
def pair_ranks(spark, sf_dir):
    s = chemistry.saenger(F.col("one"), F.col("two"), F.col("lw"))
    return _pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", interactions.pair_rank(F.col("one"), F.col("two"), s).alias("rank"))


@query(f"""WITH p AS ({_PAIRS}), f AS (SELECT l_orderkey AS g, l_linenumber AS a, l_linenumber + 1 AS b, lw, NULL AS s FROM p), n AS (SELECT l_orderkey AS g, l_linenumber AS r, one FROM p)
    SELECT f.g AS l_orderkey, f.a AS l_linenumber, t.s AS saenger FROM f LEFT JOIN n x ON x.g = f.g AND x.r = f.a LEFT JOIN n y ON y.g = f.g AND y.r = f.b LEFT JOIN (VALUES {_SAENGER}) t(k, s) ON k = x.one || y.one || ' ' || lw""")
def fill_saenger(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    unit = lambda add: (F.col("l_orderkey") * 100 + F.col("l_linenumber") + add)
    found = p.select("l_orderkey", "l_linenumber", unit(0).alias("residue_1"), unit(1).alias("residue_2"), "lw", _none().alias("saenger"))
    letters = p.select(unit(0).alias("residue"), F.col("one").alias("letter"))
    return interactions.fill_saenger(found, letters).select("l_orderkey", "l_linenumber", "saenger")


# -- residues -------------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND length(p_brand) THEN substr(p_brand, p_size, 1) WHEN length(p_name) = 1 THEN p_name
    WHEN regexp_full_match(p_name, '[Dd].') THEN substr(p_name, 2, 1) WHEN regexp_matches(p_name, '[A-Za-z]$') THEN right(p_name, 1) ELSE 'n' END AS letter FROM part""")
def one_letter_names(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", chemistry.one_letter(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("letter"))


_ATOM_NAMES = ("N1", "C2", "N3", "C4", "C5", "C6", "N6", "O6", "N7", "C8", "N9", "O2", "N4", "O4", "C1'", "C2'", "C3'", "C4'", "O4'", "O2'", "P", "C7", "N2")
_ATOM = _pick(_ATOM_NAMES, f"(l_partkey * 7 + l_suppkey * 3 + l_linenumber * 5) % {len(_ATOM_NAMES)}")
_NAMES = f"SELECT l_suppkey % 40 * 100 + l_partkey % 60 AS g, list_distinct(list({_ATOM})) AS names FROM lineitem GROUP BY 1"


def _names(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 40 * 100 + l_partkey % 60 AS g", f"{_ATOM} AS name")
    return rows.groupBy("g").agg(F.collect_set("name").alias("names"))


def _overlap(names: tuple[str, ...]) -> str:
    return f"len(list_intersect(names, list_value{_listed(names)}))"


_PARTS = ", ".join(f"{_overlap(annotate.BASE_ATOMS[k])} / {len(annotate.BASE_ATOMS[k])} AS p{k}" for k in "ACGUT")


@query(f"""WITH n AS ({_NAMES}), p AS (SELECT g, {_PARTS} FROM n), m AS (SELECT *, greatest(pA, pC, pG, pU, pT) AS m FROM p)
    SELECT g, CASE WHEN m = 0 THEN '?' WHEN pA = m THEN 'A' WHEN pC = m THEN 'C' WHEN pG = m THEN 'G' WHEN pU = m THEN 'U' ELSE 'T' END AS letter FROM m""")
def letters_by_overlap(spark, sf_dir):
    return _names(spark, sf_dir).select("g", chemistry.letter_by_overlap(F.col("names")).alias("letter"))


_TEMPLATE_COUNTS = ", ".join(f"{_overlap(v)} AS t{k}" for k, v in chemistry.TEMPLATES.items())
_FIRST_TEMPLATE = " ".join(f"WHEN t{k} = m THEN '{k if len(k) == 1 else k[1].lower()}'" for k in chemistry.TEMPLATES)


@query(f"""WITH n AS ({_NAMES}), c AS (SELECT g, {_overlap(chemistry.REQUIRED)} = {len(chemistry.REQUIRED)} AS whole, {_TEMPLATE_COUNTS} FROM n), m AS (SELECT *, greatest({', '.join('t' + k for k in chemistry.TEMPLATES)}) AS m FROM c)
    SELECT g, whole, CASE WHEN NOT whole THEN 'x' {_FIRST_TEMPLATE} END AS letter FROM m""")
def letters_by_template(spark, sf_dir):
    names = F.col("names")
    return _names(spark, sf_dir).select("g", chemistry.has_required_atoms(names).alias("whole"), chemistry.letter_by_template(F.lit("xyz"), names).alias("letter"))


_HAS_BASE = " ".join(f"WHEN g % 5 = {k} THEN {_overlap(chemistry.HEAVY[b])} = {len(chemistry.HEAVY[b])}" for k, b in enumerate("ACGU"))


@query(f"WITH n AS ({_NAMES}) SELECT g, CASE {_HAS_BASE} ELSE false END AS whole FROM n")
def base_atoms_present(spark, sf_dir):
    letter = F.expr(_pick(tuple("ACGUT"), "g % 5"))
    return _names(spark, sf_dir).select("g", chemistry.has_base_atoms(letter, F.col("names")).alias("whole"))


@query(f"""WITH n AS ({_NAMES}), r AS (SELECT g, {_pick(("g", "dA", "PSU", "ALA", "DI"), "g % 5")} AS name, names FROM n)
    SELECT g, CASE WHEN upper(name) IN {_listed(residues.RNA_NAMES)} THEN 'RNA' WHEN upper(name) IN {_listed(residues.DNA_NAMES)} THEN 'DNA' WHEN list_contains(names, 'O2''') THEN 'RNA'
        WHEN {_overlap(residues.DEOXY_SUGAR)} >= 4 THEN 'DNA' ELSE 'Other' END AS class FROM r""")
def molecule_classes(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("name", F.expr(_pick(("g", "dA", "PSU", "ALA", "DI"), "g % 5")))
    return rows.select("g", residues.molecule_class(F.col("name"), F.col("names")).alias("class"))


_INNER = f"""CASE WHEN list_contains(names, {_pick(("N6", "N4", "O6", "O4", "O4"), "g % 5")}) THEN {_pick(("N6", "N4", "O6", "O4", "O4"), "g % 5")} """ + " ".join(f"WHEN list_contains(names, '{n}') THEN '{n}'" for n in ("C6", "C4", "O6", "N6", "S6", "O4", "N4", "S4")) + " ELSE 'any' END"
_OUTER = f"""CASE WHEN list_contains(names, {_pick(("N9", "N1", "N9", "N1", "N1"), "g % 5")}) THEN {_pick(("N9", "N1", "N9", "N1", "N1"), "g % 5")} """ + " ".join(f"WHEN list_contains(names, '{n}') THEN '{n}'" for n in ("N9", "N1", "C1''")) + " ELSE 'any' END"


@query(f"WITH n AS ({_NAMES}) SELECT g, {_INNER} AS inner_atom, {_OUTER} AS outer_atom FROM n")
def innermost_and_outermost(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("atoms", F.map_from_arrays("names", F.transform("names", lambda n: F.array(F.lit(0.0)))))
    letter, atoms, names = F.expr(_pick(tuple("ACGUT"), "g % 5")), F.col("atoms"), F.col("names")
    known = lambda c, fallbacks: F.when(F.arrays_overlap(names, F.array(*map(F.lit, fallbacks))), c).otherwise("any")
    return rows.select("g", known(chemistry.innermost_atom(letter, atoms), ("C6", "C4", "O6", "N6", "O4", "N4")).alias("inner_atom"), known(chemistry.outermost_atom(letter, atoms), ("N9", "N1", "C1'")).alias("outer_atom"))


_KINDS = ("A", "DG", "HOH", "NA", "ALA", "LIG", "PB", "I")


@query(f"WITH p AS (SELECT p_partkey, {_pick(_KINDS, 'p_partkey % 8')} AS name FROM part) SELECT p_partkey, name FROM p WHERE name NOT IN ('ALA', 'LIG')")
def polymer_filter(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    atoms = part.select("p_partkey", F.lit("f").alias("path"), F.lit(1).alias("model"), F.lit("A").alias("chain_id"), F.col("p_partkey").alias("residue_number"), _none().alias("insertion_code"), F.expr(_pick(_KINDS, "p_partkey % 8")).alias("residue_name"), F.lit("C1").alias("atom_name"))
    return structure.keep_polymers(atoms, water=True, ions=True).select("p_partkey", F.col("residue_name").alias("name"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IS NULL OR l_returnflag IN ('', '.', '?', 'R')")
def altloc_named(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").where(residues.altloc(F.col("l_returnflag"), "R")).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey AS path, max(l_partkey) <= 99999 AND max(length(l_shipmode)) <= 4 AND max(l_suppkey) <= 60 AS fits FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def fits_limits(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    atoms = lines.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("serial"), F.substring(F.concat("l_returnflag", "l_linestatus"), 1, 1).alias("chain_id"), (F.col("l_suppkey") + (structure.NUMBERS - 60)).alias("residue_number"))
    return structure.fits_pdb(atoms)


@query("""WITH u AS (SELECT o_orderkey, o_custkey % 40 AS a, o_orderkey % 7 AS b FROM orders), c AS (SELECT min(c_custkey) AS r, c_nationkey * 2 AS a, c_custkey % 7 AS b FROM customer GROUP BY 2, 3), d AS (SELECT min(c_custkey) AS r, c_custkey % 50 AS a, c_nationkey % 7 AS b FROM customer GROUP BY 2, 3)
    SELECT o_orderkey, coalesce(c.r, d.r, -1) AS found FROM u LEFT JOIN c USING (a, b) LEFT JOIN d USING (a, b)""")
def find_residues(spark, sf_dir):
    units = _read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 40 AS a", "o_orderkey % 7 AS b")
    known = _read(spark, sf_dir, "customer").selectExpr("c_custkey AS residue", "c_nationkey * 2 AS la", "c_custkey % 7 AS lb", "c_custkey % 50 AS aa", "c_nationkey % 7 AS ab")
    units = units.selectExpr("o_orderkey", "a AS la", "b AS lb", "a AS aa", "b AS ab")
    return interactions.find_residues(units, known, ["la", "lb"], ["aa", "ab"]).select("o_orderkey", F.coalesce("found", F.lit(-1)).alias("found"))


# -- geometry -------------------------------------------------------------------------------------------------------
_NORMAL_STEPS = ", ".join(f"x{3 * s + k} - x{k} AS {n}{k}" for n, s in (("a", 1), ("b", 2)) for k in range(3))
_NORMAL = f"n AS (SELECT *, {', '.join(f'{e} AS n{k}' for k, e in enumerate(_cross_sql('a', 'b')))} FROM (SELECT *, {_NORMAL_STEPS} FROM x)), u AS (SELECT *, sqrt(n0 * n0 + n1 * n1 + n2 * n2) AS l FROM n)"


@query(f"WITH x AS ({_POINTS}), {_NORMAL} SELECT id, round(n0 / l, 6) AS x, round(n1 / l, 6) AS y, round(n2 / l, 6) AS z FROM u")
def base_normals(spark, sf_dir):
    n = geometry.base_normal(*map(_point, range(3)))
    return _vectors(spark, sf_dir).select("id", *[F.round(n[k], 6).alias(c) for k, c in enumerate("xyz")])


_UP = "((x9 - x0) * n0 / l + (x10 - x1) * n1 / l + (x11 - x2) * n2 / l)"


@query(f"WITH x AS ({_POINTS}), {_NORMAL} SELECT id, round(abs({_UP}), 6) AS inter_planar, round(sqrt(power(x9 - x0 - {_UP} * n0 / l, 2) + power(x10 - x1 - {_UP} * n1 / l, 2) + power(x11 - x2 - {_UP} * n2 / l, 2)), 6) AS lateral FROM u")
def stacking_distances(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", _point(0).alias("c1"), geometry.base_normal(*map(_point, range(3))).alias("n1"), _point(3).alias("c2"))
    c1, n1, c2 = F.col("c1"), F.col("n1"), F.col("c2")
    return v.select("id", F.round(planes.inter_planar_distance(c1, n1, c2), 6).alias("inter_planar"), F.round(planes.lateral_displacement(c1, n1, c2), 6).alias("lateral"))


def _gap(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"power(x{3 * a + k} - x{3 * b + k}, 2)" for k in range(3)) + ")"


_BOND_DOT = " + ".join(f"(x{k} - x{3 + k}) * (x{6 + k} - x{3 + k})" for k in range(3))


@query(f"""WITH x AS ({_POINTS}), d AS (SELECT id, {_gap(0, 1)} AS ad, {_gap(1, 2)} AS dc, {_BOND_DOT} AS p FROM x)
    SELECT id, round(ad * 10, 6) AS antecedent_donor, round(dc * 10, 6) AS donor_acceptor, round(degrees(acos(greatest(-1, least(1, p / (ad * dc))))), 6) AS angle,
        dc * 10 BETWEEN 2.5 AND 3.5 AND degrees(acos(greatest(-1, least(1, p / (ad * dc))))) BETWEEN 100 AND 180 AS valid FROM d""")
def hbond_geometry(spark, sf_dir):
    ten = lambda p: F.transform(p, lambda x: x * 10)
    v = _vectors(spark, sf_dir).select("id", ten(_point(0)).alias("a"), ten(_point(1)).alias("d"), ten(_point(2)).alias("c"))
    out = planes.hbond_parameters(v)
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("antecedent_donor", "donor_acceptor", "angle")], "valid")


_DONOR = _pick(("N6", "C2", "C8", "N1", "N2", "N4", "C5", "C6", "N3", "C7", "O2'"), "id % 11")
_BASE = _pick(tuple("AGCUT"), "id // 11 % 5")
_BACKBONE = " ".join(f"WHEN b || ' ' || d = '{k}' THEN {v}" for k, v in chemistry.BACKBONE_CLASS.items()) + " " + " ".join(f"WHEN b || ' ' || d = '{k}' THEN CASE WHEN t > -pi() / 2 AND t < pi() / 2 THEN {near} ELSE {far} END" for k, (_, _, near, far) in chemistry.BACKBONE_TURNED.items())


@query(f"{_TORSION}, k AS (SELECT id, t, {_BASE} AS b, {_DONOR} AS d FROM t) SELECT id, CAST(CASE {_BACKBONE} ELSE -1 END AS INTEGER) AS code FROM k")
def backbone_classes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    letter, donor = F.expr(_BASE.replace("//", "DIV")), F.expr(_DONOR)
    atoms = F.create_map(*[x for n, p in (("N1", 0), ("N3", 0), ("C6", 1), ("C4", 1), ("C2", 1)) for x in (F.lit(n), _point(p))])
    atoms = F.when(donor == "N2", F.map_concat(F.map_filter(atoms, lambda k, _: ~k.isin("C6", "C4")), F.create_map(F.lit("x"), _point(0)))).otherwise(atoms)
    return v.select("id", chemistry.backbone_class(letter, donor, atoms, _point(2), _point(3)).alias("code")).fillna(-1)


_SCALE = 8


@query(f"""WITH x AS ({_POINTS}), r AS (SELECT id, {_gap(0, 1)} * {_SCALE} <= 2 AND {_gap(0, 2)} * {_SCALE} <= 2 AND {_gap(1, 2)} * {_SCALE} <= 3 AS ok FROM x)
    SELECT CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS index, id FROM r WHERE ok""")
def rnaview_numbers(spark, sf_dir):
    scaled = lambda p: F.transform(p, lambda x: x * _SCALE)
    atoms = F.create_map(F.lit("N1"), scaled(_point(0)), F.lit("C2"), scaled(_point(1)), F.lit("C6"), scaled(_point(2)))
    table = _vectors(spark, sf_dir).select(F.lit("f").alias("path"), F.col("id").alias("residue"), F.lit("A").alias("chain_id"), F.col("id").alias("residue_number"), _none().alias("insertion_code"), F.lit("A").alias("residue_name"), atoms.alias("atoms"))
    return tools.rnaview_indices(table).select("index", F.col("residue_number").alias("id"))


@query(f"""WITH x AS (SELECT vec_id AS id, label AS g, {', '.join(f'CAST(embedding[{k + 1}] AS DOUBLE) AS x{k}' for k in range(6))} FROM embeddings),
    d AS (SELECT *, CASE WHEN lag(id) OVER w IS NULL OR sqrt({' + '.join(f'power(lag(x{k}) OVER w - x{3 + k}, 2)' for k in range(3))}) * 20 >= 2.4 THEN 1 ELSE 0 END AS s FROM x WINDOW w AS (PARTITION BY g ORDER BY id))
    SELECT id, CAST(sum(s) OVER (PARTITION BY g ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM d""")
def bonded_segments(spark, sf_dir):
    scaled = lambda p: F.transform(p, lambda x: x * 20)
    table = _vectors(spark, sf_dir).select(F.lit("f").alias("path"), F.lit(1).alias("model"), F.col("group").cast("string").alias("chain_id"), F.col("id").alias("residue"), F.create_map(F.lit("O3'"), scaled(_point(0)), F.lit("P"), scaled(_point(1))).alias("atoms"))
    return structure.with_segments(table).select(F.col("residue").alias("id"), F.col("segment").cast("long").alias("segment"))


_CLASH = f"""SELECT o_custkey AS g, o_orderkey AS id, o_orderkey // 50 AS r, {_pick(tuple("CNOP"), "o_orderkey % 4")} AS n, o_orderkey % 7 / 3.0 AS x, o_orderkey % 5 / 4.0 AS y, o_orderkey % 11 / 9.0 AS z, CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END AS o FROM orders"""
_RADIUS = "CASE {0}.n WHEN 'C' THEN 0.6 WHEN 'N' THEN 0.54 WHEN 'O' THEN 0.53 ELSE 0.94 END"


def _clash_atoms(spark, sf_dir) -> DataFrame:
    atoms = _read(spark, sf_dir, "orders").selectExpr("o_custkey AS path", "o_orderkey AS line_number", "CAST(o_orderkey DIV 50 AS INT) AS residue_number", f"{_pick(tuple('CNOP'), 'o_orderkey % 4')} AS atom_name", "o_orderkey % 7 / 3.0D AS x", "o_orderkey % 5 / 4.0D AS y", "o_orderkey % 11 / 9.0D AS z", "CASE o_orderkey % 3 WHEN 0 THEN 0.5D WHEN 1 THEN 1.0D END AS occupancy")
    return atoms.withColumns({"model": F.lit(1), "chain_id": F.lit("A"), "insertion_code": _none(), "residue_name": F.lit("A")})


@query(f"""WITH a AS ({_CLASH}), m AS (SELECT *, CASE WHEN r = lag(r) OVER w THEN 0 ELSE 1 END AS s FROM a WINDOW w AS (PARTITION BY g ORDER BY id)), q AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY id) AS residue FROM m)
    SELECT a.g AS path, a.id AS id_1, b.id AS id_2 FROM q a JOIN q b ON a.g = b.g AND a.id < b.id AND a.residue <> b.residue
        AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= {_RADIUS.format("a")} + {_RADIUS.format("b")} AND abs(coalesce(a.o, 1) + coalesce(b.o, 1) - 1) < 1e-9""")
def clash_pairs(spark, sf_dir):
    return structure.clashes(_clash_atoms(spark, sf_dir), any_occupancy=False).select("path", "id_1", "id_2")


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-5.0 * (l_quantity / 5 - 3))) / (1 + exp(5.0 * (l_quantity / 5 - 7))), 6) AS density FROM lineitem")
def end_distance_density(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(stems.end_distance_density(F.col("l_quantity") / 5), 6).alias("density"))


_WAYS = (("cs55", 0, 2, 147.3), ("cs53", 0, 3, -32.7), ("cs35", 1, 2, 32.7), ("cs33", 1, 3, 212.7))


def _far(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"power(x{3 * a + k} - x{3 * b + k}, 2)" for k in range(3)) + ") * 20"


@query(f"""WITH x AS ({_POINTS}), d AS (SELECT id, {', '.join(f'{_far(a, b)} AS {n}' for n, a, b, _ in _WAYS)} FROM x), m AS (SELECT *, least(cs55, cs53, cs35, cs33) AS gap FROM d)
    SELECT id, CASE {' '.join(f"WHEN {n} = gap THEN '{n}'" for n, *_ in _WAYS)} END AS type, round(gap, 6) AS gap FROM m""")
def nearest_stem_ends(spark, sf_dir):
    ends = lambda a, b: F.array(*[F.transform(_point(k), lambda x: x * 20) for k in (a, b)])
    v = _vectors(spark, sf_dir)
    table = v.select("id", F.lit(0).alias("stem"), ends(0, 1).alias("centroids")).unionByName(v.select("id", F.lit(1).alias("stem"), ends(2, 3).alias("centroids")))
    return stems.inter_stem_parameters(table).select("id", "type", F.round("gap", 6).alias("gap"))


# -- secondary structures -------------------------------------------------------------------------------------------
_BRACKETS = "SELECT o_orderkey AS id, o_orderkey % 5 + 1 AS a, o_custkey % 3 AS b FROM orders"
_TEXT = "repeat('(', CAST(a AS INT)) || repeat('[', CAST(b AS INT)) || '...' || repeat(')', CAST(a AS INT)) || repeat(']', CAST(b AS INT))"
_BRACKET_PAIRS = f"s AS ({_BRACKETS}), p AS (SELECT id, a, b, k AS i, 2 * a + b + 4 - k AS j, 0 AS o FROM s, (SELECT unnest(range(1, 8)) AS k) WHERE k <= a UNION ALL SELECT id, a, b, a + k, 2 * a + 2 * b + 4 - k, 1 FROM s, (SELECT unnest(range(1, 8)) AS k) WHERE k <= b)"


def _structures(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 5 + 1 AS a", "o_custkey % 3 AS b")
    return rows.selectExpr("id", f"{_TEXT} AS structure").withColumn("sequence", F.translate("structure", "()[].", "GCAUN"))


@query(f"WITH {_BRACKET_PAIRS} SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM p")
def bracket_pairs(spark, sf_dir):
    return secondary.pairs_of(_structures(spark, sf_dir)).select("id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query(f"""WITH {_BRACKET_PAIRS}, n AS (SELECT id, CAST(unnest(range(1, 2 * a + 2 * b + 4)) AS BIGINT) AS i, translate({_TEXT}, '()[].', 'GCAUN') AS t FROM s), e AS (SELECT id, i, j FROM p UNION ALL SELECT id, j, i FROM p)
    SELECT id, n.i || ' ' || substr(t, CAST(n.i AS INT), 1) || ' ' || coalesce(j, 0) AS line FROM n LEFT JOIN e USING (id, i)""")
def bpseq_lines(spark, sf_dir):
    rows = secondary.bpseq_of(_structures(spark, sf_dir))
    return rows.select("id", bpseq_line(F.col("i"), F.col("base"), F.col("pair")).alias("line"))


@query(f"WITH {_BRACKET_PAIRS} SELECT id, CAST(min(i) AS BIGINT) AS i, CAST(max(j) AS BIGINT) AS j, count(*) AS length FROM p GROUP BY id, o")
def stems_of_brackets(spark, sf_dir):
    stems_ = secondary.stems_in(secondary.pairs_in(F.col("structure")))
    rows = _structures(spark, sf_dir).select("id", F.explode(stems_).alias("s"))
    return rows.select("id", F.col("s.i").cast("long").alias("i"), F.col("s.j").cast("long").alias("j"), "s.length")


@query(f"WITH {_BRACKET_PAIRS} SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM p WHERE CASE o WHEN 0 THEN a > 1 ELSE b > 1 END")
def without_isolated_pairs(spark, sf_dir):
    kept = secondary.without_isolated_in(secondary.pairs_in(F.col("structure")))
    rows = _structures(spark, sf_dir).select("id", F.explode(kept).alias("p"))
    return rows.select("id", F.col("p.i").cast("long").alias("i"), F.col("p.j").cast("long").alias("j"))


@query(f"WITH {_BRACKET_PAIRS} SELECT id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(o AS INTEGER) AS \"order\" FROM p")
def pseudoknot_first_come(spark, sf_dir):
    ordered = secondary.orders_in(secondary.pairs_in(F.col("structure")))
    return _structures(spark, sf_dir).select("id", F.explode(ordered).alias("p")).select("id", "p.i", "p.j", "p.order")


@query(f"WITH s AS ({_BRACKETS}) SELECT id, {_TEXT} AS structure FROM s")
def bracket_round_trip(spark, sf_dir):
    ordered = secondary.orders_in(secondary.pairs_in(F.col("structure")))
    return _structures(spark, sf_dir).select("id", secondary.dot_bracket_in(F.length("structure"), ordered).alias("structure"))


_HAIRPINS = "SELECT o_orderkey AS id, o_orderkey % 4 + 1 AS a, o_custkey % 3 AS p, o_custkey % 5 AS q FROM orders"


@query(f"""WITH s AS ({_HAIRPINS}), e AS (
        SELECT id, 'stem' AS kind, p + 1 AS first, p + a AS last FROM s UNION ALL SELECT id, 'hairpin', p + a, p + a + 4 FROM s
        UNION ALL SELECT id, '5''', 1, p + 1 FROM s WHERE p > 0 UNION ALL SELECT id, '3''', p + 2 * a + 3, p + 2 * a + 3 + q FROM s WHERE q > 0)
    SELECT CAST(id AS VARCHAR) AS id, kind, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM e""")
def hairpin_elements(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 4 + 1 AS a", "o_custkey % 3 AS p", "o_custkey % 5 AS q")
    text = "repeat('.', CAST(p AS INT)) || repeat('(', CAST(a AS INT)) || '...' || repeat(')', CAST(a AS INT)) || repeat('.', CAST(q AS INT))"
    found = secondary.elements_in(secondary.partners_in(F.expr(text)))
    elements = rows.select(F.col("id").cast("string").alias("id"), F.explode(found).alias("e"))
    return elements.select("id", "e.kind", F.col("e.strands")[0]["first"].alias("first"), F.col("e.strands")[0]["last"].alias("last"))


# -- strands --------------------------------------------------------------------------------------------------------
_RESIDUES = f"SELECT o_custkey AS g, o_orderkey AS r, {_pick(('A', 'B'), 'o_orderkey // 500 % 2')} AS c, CAST(o_orderkey % 12 AS INTEGER) AS n, o_orderkey % 3 = 0 AS k, {_pick(tuple('ACGU'), 'o_orderkey % 4')} AS b FROM orders"
_PLACES = f"""q AS ({_RESIDUES}), h AS (SELECT *, CASE WHEN lag(c) OVER w = c AND NOT k AND n - lag(n) OVER w - 1 > 0 THEN n - lag(n) OVER w - 1 ELSE 0 END AS gap, CASE WHEN lag(c) OVER w = c THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY g ORDER BY r)),
    z AS (SELECT *, CAST(row_number() OVER w + sum(gap) OVER w AS INTEGER) AS place, sum(new) OVER w AS strand FROM h WINDOW w AS (PARTITION BY g ORDER BY r ROWS UNBOUNDED PRECEDING))"""


def _placed(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").selectExpr("o_custkey AS path", "o_orderkey AS residue", f"{_pick(('A', 'B'), 'o_orderkey DIV 500 % 2')} AS chain_id", "CAST(o_orderkey % 12 AS INT) AS residue_number", "o_orderkey % 3 = 0 AS connected", f"{_pick(tuple('ACGU'), 'o_orderkey % 4')} AS letter")
    return interactions.gapped_places(rows)


@query(f"WITH {_PLACES} SELECT g AS path, r AS residue, place FROM z")
def gapped_places(spark, sf_dir):
    return _placed(spark, sf_dir).select("path", "residue", "place")


_STRANDS = "t AS (SELECT g, strand, string_agg(repeat('?', CAST(gap AS INT)) || b, '' ORDER BY r) AS sequence FROM z GROUP BY 1, 2)"


@query(f"WITH {_PLACES}, {_STRANDS} SELECT g AS path, CAST(strand AS BIGINT) AS strand, sequence FROM t")
def strand_sequences(spark, sf_dir):
    return interactions.strand_sequences(_placed(spark, sf_dir)).select("path", F.col("strand").cast("long").alias("strand"), "sequence")


@query(f"WITH {_PLACES}, {_STRANDS} SELECT g AS path, CAST(strand AS BIGINT) AS strand, lower(sequence) AS structure FROM t")
def split_by_strand(spark, sf_dir):
    strands = interactions.strand_sequences(_placed(spark, sf_dir))
    whole = strands.groupBy("path").agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("strand", "sequence"))), lambda x: x["sequence"]), "")).alias("structure"))
    return interactions.split_by_strand(whole, strands).withColumn("strand", F.col("strand").cast("long"))


_ENDS = "m AS (SELECT g, min(r) AS lo, max(r) AS hi FROM z GROUP BY g HAVING min(r) < max(r)), e AS (SELECT m.g, lo AS r, y.place AS pair FROM m JOIN z y ON y.g = m.g AND y.r = hi UNION ALL SELECT m.g, hi, y.place FROM m JOIN z y ON y.g = m.g AND y.r = lo)"


@query(f"""WITH {_PLACES}, {_ENDS} SELECT path, i, base, pair FROM (SELECT z.g AS path, z.place AS i, z.b AS base, coalesce(e.pair, CAST(0 AS INTEGER)) AS pair FROM z LEFT JOIN e USING (g, r)
    UNION ALL SELECT g, CAST(unnest(range(CAST(place - gap AS INTEGER), place)) AS INTEGER), '?', CAST(0 AS INTEGER) FROM z WHERE gap > 0)""")
def bpseq_with_gaps(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    pairs = placed.groupBy("path").agg(F.min("residue").alias("residue_1"), F.max("residue").alias("residue_2")).where("residue_1 < residue_2")
    return interactions.bpseq_with_gaps(placed, pairs)


@query(f"""WITH p AS ({_PAIRS}), e AS (SELECT l_orderkey AS path, l_linenumber AS a, l_linenumber + 1 AS b, lw FROM p) SELECT path, a AS residue_1, b AS residue_2, lw FROM e UNION SELECT path, b, a, lw[1] || lw[3] || lw[2] FROM e""")
def both_directions(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("residue_1"), (F.col("l_linenumber") + 1).alias("residue_2"), "lw", _none().alias("topology"))
    return interactions.both_directions(p).select("path", "residue_1", "residue_2", "lw")


_FOUND_KIND = _pick(tuple(interactions.KINDS), "l_linenumber % 5")


@query(f"""WITH p AS (SELECT p.*, {_FOUND_KIND} AS k FROM ({_PAIRS}) p), s AS (SELECT p.*, s FROM p LEFT JOIN (VALUES {_SAENGER}) t(k, s) ON t.k = one || two || ' ' || lw)
    SELECT l_orderkey AS path, 'A.' || one || l_linenumber AS nt1, 'A.' || two || (l_linenumber + 1) AS nt2, CASE k WHEN 'base-pair' THEN 'base pair' WHEN 'stacking' THEN 'stacking' ELSE k || ' interaction' END AS type,
        CASE k WHEN 'base-pair' THEN lw WHEN 'stacking' THEN 'upward' WHEN 'other' THEN '' ELSE '4x' END AS "classification-1", CASE WHEN k = 'base-pair' THEN coalesce(s, '') ELSE '' END AS "classification-2" FROM s""")
def interaction_rows(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("kind", F.expr(_FOUND_KIND)).withColumn("saenger", chemistry.saenger(F.col("one"), F.col("two"), F.col("lw")))
    name = lambda letter, add: residues.full_name(F.lit("A"), F.col(letter), F.col("l_linenumber") + add, _none())
    return interactions.csv_rows(p.select(F.col("l_orderkey").alias("path"), name("one", 0).alias("nt_1"), name("two", 1).alias("nt_2"), "kind", "lw", "saenger", F.lit("upward").alias("topology"), F.lit("4x").alias("code")))


# -- adapters -------------------------------------------------------------------------------------------------------
_FILES = ("x_basepair_detail.txt", "x.out", "x_basepair.json", "x_stdout.txt", "x.pairing.txt", "x.json", "x.csv", "x.cif")
_FILE = _pick(_FILES, "p_partkey % 8")


@query(f"SELECT p_partkey, CASE p_partkey % 8 {' '.join(f'WHEN {k} THEN {chr(39)}{t}{chr(39)}' for k, t in enumerate(('fr3d', 'rnaview', 'bpnet', 'mc-annotate', 'barnaba', 'dssr', 'dnatco', 'maxit')))} END AS tool FROM part")
def detect_tool(spark, sf_dir):
    head = F.when(F.col("p_partkey") % 8 == 6, "pdbid,ntC").otherwise("data_x")
    return _read(spark, sf_dir, "part").select("p_partkey", annotations.detect_tool(F.expr(_FILE), head).alias("tool"))


_CODES = ("cWW", "ntHSa", "s35", "s33", "3BPh", "n7BR", "xyz")
_CODE = _pick(_CODES, "l_partkey % 7")


@query(f"""WITH f AS (SELECT l_orderkey AS number_1, l_linenumber AS number_2, {_CODE} AS c FROM lineitem)
    SELECT number_1, number_2, CASE WHEN c IN ('cWW', 'ntHSa') THEN 'base-pair' WHEN c IN ('s35', 's33') THEN 'stacking' WHEN c = '3BPh' THEN 'base-phosphate' WHEN c = 'n7BR' THEN 'base-ribose' ELSE 'other' END AS kind,
        CASE c WHEN 'cWW' THEN 'cWW' WHEN 'ntHSa' THEN 'tHS' END AS lw, CASE c WHEN 's35' THEN 'outward' WHEN 's33' THEN 'downward' END AS topology FROM f""")
def adapter_fr3d(spark, sf_dir):
    unit = lambda c: F.concat(F.lit("1ABC|1|A|G|"), F.col(c).cast("string"))
    lines = _read(spark, sf_dir, "lineitem").select(F.lit("f").alias("path"), F.concat_ws("\t", unit("l_orderkey"), F.expr(_CODE), unit("l_linenumber"), F.lit("0")).alias("value"))
    return annotations.parse_fr3d(lines).select(F.col("number_1").cast("long").alias("number_1"), F.col("number_2").cast("int").alias("number_2"), "kind", "lw", "topology")


@query(f"WITH p AS ({_PAIRS}) SELECT l_orderkey AS path, one AS name_1, l_linenumber AS number_1, two AS name_2, CAST(l_linenumber + 1 AS INTEGER) AS number_2, lw FROM p")
def adapter_dssr(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    unit = lambda letter, add: F.concat(F.lit("A."), F.col(letter), (F.col("l_linenumber") + add).cast("string"))
    pairs = p.groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_list(F.struct(unit("one", 0).alias("nt1"), unit("two", 1).alias("nt2"), F.col("lw").alias("LW"))).alias("pairs"))
    texts = pairs.select("path", F.to_json(F.struct("pairs")).alias("value"))
    return annotations.parse_dssr(texts).select(F.col("path").cast("long").alias("path"), "name_1", F.col("number_1").cast("int").alias("number_1"), "name_2", F.col("number_2").cast("int").alias("number_2"), "lw")


_TOKENS = ("XIX", "n/a", "!(b_s)", "!b_(O1P,O2P)", "!1H(b_b)", "XII,XIII", "what")


@query(f"""WITH f AS (SELECT l_orderkey AS path, l_linenumber AS n, l_partkey % 7 AS t, {_pick(("+/+", "W/H", "S/S", "?/W"), "l_suppkey % 4")} AS e, {_pick(("cis", "tran"), "l_suppkey % 2")} AS s FROM lineitem),
    g AS (SELECT path, CAST(n AS INTEGER) AS number_1, CASE WHEN t IN (0, 1, 5) AND e <> '?/W' THEN s[1] || CASE WHEN e = '+/+' THEN 'WW' ELSE replace(e, '/', '') END END AS lw, t FROM f)
    SELECT path, number_1, CASE WHEN lw IS NOT NULL THEN 'base-pair' WHEN t IN (0, 1, 4, 5) THEN 'other' WHEN t = 2 THEN 'base-ribose' ELSE 'base-phosphate' END AS kind, lw, CASE WHEN lw IS NOT NULL AND t = 0 THEN 'XIX' WHEN lw IS NOT NULL AND t = 5 THEN 'XII' END AS saenger FROM g WHERE t <> 6""")
def adapter_rnaview(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS path", "l_linenumber AS line_number", f"{_pick(_TOKENS, 'l_partkey % 7')} AS token", f"{_pick(('+/+', 'W/H', 'S/S', '?/W'), 'l_suppkey % 4')} AS e", f"{_pick(('cis', 'tran'), 'l_suppkey % 2')} AS s")
    text = F.format_string("%6d_%d, A: %5d G-C %5d B: %s %s         %s", "line_number", "line_number", "line_number", "line_number", "e", "s", "token")
    heads = rows.select("path").distinct().select("path", F.lit(-1).alias("line_number"), F.lit("BEGIN_base-pair").alias("value"))
    lines = rows.select("path", "line_number", text.alias("value")).unionByName(heads)
    return tools.parse_rnaview(lines).select(F.col("path").cast("long").alias("path"), "number_1", "kind", "lw", "saenger")


@query(f"""WITH f AS (SELECT l_orderkey AS path, CAST(l_linenumber AS INTEGER) AS number_1, l_partkey % 4 AS t FROM lineitem)
    SELECT path, number_1, CASE t WHEN 0 THEN 'base-pair' WHEN 1 THEN 'base-ribose' WHEN 2 THEN 'base-phosphate' ELSE 'other' END AS kind, CASE WHEN t = 0 THEN 'cWH' END AS lw, CASE WHEN t = 0 THEN 'XX' END AS saenger FROM f""")
def adapter_mc_annotate(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS path", "l_linenumber AS line_number", f"{_pick(('Ww/Hh pairing antiparallel cis XX', 'Ss/O2P_ pairing', 'Bh/O2P adjacent_5p', 'Ww/Ww cis one_hbond'), 'l_partkey % 4')} AS token")
    token = F.regexp_replace("token", "O2P_", "O2'")
    heads = rows.select("path").distinct().select("path", F.lit(-1).alias("line_number"), F.lit("Base-pairs ----").alias("value"))
    lines = rows.select("path", "line_number", F.concat(F.lit("A"), F.col("line_number").cast("string"), F.lit("-B7 : G-C "), token).alias("value")).unionByName(heads)
    return tools.parse_mc_annotate(lines).select(F.col("path").cast("long").alias("path"), "number_1", "kind", "lw", "saenger")


@query("""SELECT l_orderkey AS path, CAST(l_linenumber AS INTEGER) AS number_1, CASE l_suppkey % 3 WHEN 0 THEN 'cWW' ELSE 'tHS' END AS lw FROM lineitem WHERE l_partkey % 4 <> 0 AND l_suppkey % 3 <> 2""")
def adapter_dnatco(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS path", "'A' AS chain1", "'B' AS chain2", "l_linenumber AS nr1", "7 AS nr2", "'G' AS res1", "'C' AS res2", "'' AS ins1", "' ' AS ins2", "IF(l_partkey % 8 = 0, 'B', '') AS alt1", "'' AS alt2", "' ' AS symmetry_operation1", "IF(l_partkey % 8 = 4, '2_555', NULL) AS symmetry_operation2", f"{_pick(('cWW', 'tHs', 'zz'), 'l_suppkey % 3')} AS family")
    return tools.parse_dnatco(rows).select(F.col("path").cast("long").alias("path"), "number_1", "lw")


# -- categories, ensembles, scores ----------------------------------------------------------------------------------
@query("SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS copied FROM events")
def copy_item(spark, sf_dir):
    rows = _as_category(_read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "site")
    out = categories.copy_item(rows, "site", "user_id", "auth_id")
    return out.select(categories.item("event_id").cast("long").alias("event_id"), categories.item("event_type").alias("event_type"), categories.item("auth_id").alias("copied"))


@query("""WITH g AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), u AS (SELECT n FROM g GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1) SELECT id, n FROM g WHERE n <> (SELECT n FROM u)""")
def unequal_sizes(spark, sf_dir):
    return distill.unequal_sizes(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("""WITH m AS (SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS r FROM orders)
    SELECT r AS representative, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (id <> r), '') AS members, count(*) AS size FROM m GROUP BY 1""")
def cluster_records(spark, sf_dir):
    from pyspark.sql import Window

    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("representative"))
    return distill.cluster_records(rows).select("representative", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "size")


@query("SELECT o_orderkey, md5(concat_ws(':', o_orderkey, o_custkey, 'svd')) AS key FROM orders WHERE o_orderkey % 3 <> 0")
def distances_to_compute(spark, sf_dir):
    key = superpose.pair_key(F.lit("svd"), F.col("o_orderkey"), F.col("o_custkey"))
    wanted = _read(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    return superpose.not_cached(wanted, wanted.where("o_orderkey % 3 = 0").select("key"), ["key"])


_ANGLE_COLUMNS = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) * 9 AS {a}" for k, a in enumerate(scoring.ANGLES))
_LAST = ", ".join(f"arg_max({a}, vec_id) AS m_{a}" for a in scoring.ANGLES)
_DIFFERENCES = " UNION ALL ".join(f"SELECT path, '{a}' AS angle, n, id, {a} - m_{a} AS d FROM j" for a in scoring.ANGLES)


@query(f"""WITH e AS (SELECT vec_id, label, vec_id % 90 AS n, {_ANGLE_COLUMNS} FROM embeddings), m AS (SELECT label AS path, n, {_LAST} FROM e GROUP BY 1, 2), j AS (SELECT path, n, vec_id AS id, t.* EXCLUDE (vec_id, label, n), m.* EXCLUDE (path, n) FROM (SELECT * FROM e WHERE label = 1) t JOIN m USING (n))
    SELECT path, angle, n, round(atan2(sin(d), cos(d)), 6) AS signed FROM ({_DIFFERENCES})""")
def torsion_differences(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").selectExpr("vec_id AS residue", "label AS path", "'A' AS chain_id", "vec_id % 90 AS residue_number", "'G' AS residue_name", *[f"CAST(embedding[{k}] AS DOUBLE) * 9 AS {a}" for k, a in enumerate(scoring.ANGLES)])
    out = scoring.torsion_differences(v.where("path = 1"), v)
    return out.select("path", "angle", F.col("residue_number").alias("n"), F.round("signed", 6).alias("signed"))


_METRICS = {"mcq": "l_discount * 3", "medcq": "l_tax * 25", "rmcq": "l_quantity / 60", "circular_mad_mcq": "l_tax * 20", "p_watson_dmcq": "l_discount", "p_sim_test_dmcq": "l_tax", "mcd": "l_tax * 15 - 0.5", "medcd": "0.4 - l_discount * 9", "rmcd": "l_quantity / 70", "circular_mad_mcd": "l_discount * 10", "p_rayleigh_dmcd": "l_tax * 2", "p_wilcoxon_dmcd": "l_discount * 3"}
_M = {k: f"({v})" for k, v in _METRICS.items()}


@query(f"""SELECT l_orderkey, l_linenumber, round(0.5 * (0.4 * greatest(0, 1 - {_M['mcq']} / (pi() / 2)) + 0.6 * greatest(0, 1 - {_M['medcq']} / (pi() / 2)))
    + 0.2 * (0.15 * {_M['rmcq']} + 0.3 * greatest(0, 1 - {_M['circular_mad_mcq']}) + 0.25 * (1 - {_M['p_watson_dmcq']}) + 0.3 * (1 - {_M['p_sim_test_dmcq']}))
    + 0.3 * (0.1 * greatest(0, 1 - abs({_M['mcd']}) / (pi() / 4)) + 0.2 * greatest(0, 1 - abs({_M['medcd']}) / (pi() / 4)) + 0.1 * {_M['rmcd']} + 0.2 * greatest(0, 1 - {_M['circular_mad_mcd']} / (pi() / 4)) + 0.15 * (1 - {_M['p_rayleigh_dmcd']}) + 0.25 * (1 - {_M['p_wilcoxon_dmcd']})), 6) AS score FROM lineitem""")
def composite_score(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{v} AS {k}" for k, v in _METRICS.items()])
    return lines.select("l_orderkey", "l_linenumber", F.round(scoring.score(), 6).alias("score"))
