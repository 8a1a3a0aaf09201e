"""Registered queries of the structure engine and their SQL equivalents.

Each query runs an operator of the library on the tables at hand: vectors stand for structures or points, events and
orders for atoms, residues and pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import chemistry, circular, geometry
from helixframe.operators import categories, distill, groups, secondary, spatial, structure
from helixframe.plans.components import connected_components
from helixframe.sources import secondary as secondary_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_category(table: DataFrame, name: str) -> DataFrame:
    """A table's rows as rows of a category: values as text by column."""
    pairs = F.create_map(*[x for c in table.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return table.select(F.lit("f").alias("path"), F.lit(name).alias("category"), F.lit(0).alias("row_idx"), pairs.alias("attrs"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("group"))


def _point(i: int) -> Column:
    return F.slice("v", 3 * i + 1, 3)


_V = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS g FROM embeddings"
_PAIRS = f"v AS ({_V}), p AS (SELECT x.id AS a, y.id AS b, x.g AS ga, y.g AS gb, list_distance(x.v, y.v) AS d FROM v x JOIN v y ON x.id < y.id)"
_BOTH = f"{_PAIRS}, s AS (SELECT a, b, ga, gb, d FROM p UNION ALL SELECT b, a, gb, ga, d FROM p)"


@query(f"WITH {_PAIRS} SELECT a, b, round(d, 6) AS d FROM p")
def pairwise_l2(spark, sf_dir):
    return spatial.pair_distances(_vectors(spark, sf_dir).select("id", "v")).select("a", "b", F.round("d", 6).alias("d"))


@query(f"""WITH {_BOTH}, k AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 6), b) AS r FROM s)
    SELECT least(a, b) AS a, greatest(a, b) AS b, round(min(d), 6) AS d FROM k WHERE r <= 5 GROUP BY 1, 2""")
def knn_graph(spark, sf_dir):
    return spatial.nearest_edges(_vectors(spark, sf_dir).select("id", "v"), 5).select("a", "b", F.round("d", 6).alias("d"))


@query("""WITH p AS (SELECT vec_id AS id, CAST(embedding[1:3] AS DOUBLE[]) AS v FROM embeddings)
    SELECT x.id AS id_1, y.id AS id_2, round(list_distance(x.v, y.v), 6) AS distance FROM p x JOIN p y ON x.id < y.id AND list_distance(x.v, y.v) <= 0.0501""")
def radius_edges(spark, sf_dir):
    points = _vectors(spark, sf_dir).select("id", _point(0).alias("p"))
    return spatial.radius_join(points, 0.0501).withColumn("distance", F.round("distance", 6))


@query("""WITH p AS (SELECT vec_id AS id, label AS g, CAST(embedding[1:3] AS DOUBLE[]) AS v FROM embeddings)
    SELECT x.g AS g, least(x.id, y.id) AS id_1, greatest(x.id, y.id) AS id_2 FROM p x JOIN p y ON x.id < y.id AND x.g = y.g AND list_distance(x.v, y.v) <= 0.0801""")
def contacts_within_group(spark, sf_dir):
    points = _vectors(spark, sf_dir).select("id", F.col("group").alias("g"), _point(0).alias("p"))
    return spatial.radius_join(points, 0.0801, within=("g",)).select("g", "id_1", "id_2")


@query(f"""WITH v AS ({_V}), r AS (SELECT g, min(id) AS rep FROM v GROUP BY g), d AS (
        SELECT v.id, r.rep, row_number() OVER (PARTITION BY v.id ORDER BY round(list_distance(v.v, w.v), 6), r.rep) AS k, list_distance(v.v, w.v) AS d
        FROM v, r JOIN v w ON w.id = r.rep)
    SELECT id, rep, round(d, 6) AS d FROM d WHERE k = 1""")
def nearest_representative(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    reps = v.groupBy("group").agg(F.min_by("v", "id").alias("w"), F.min("id").alias("rep"))
    return spatial.nearest(v.select("id", "v"), reps.select("rep", "w"))


@query(f"""WITH {_BOTH}, t AS (SELECT ga AS g, a AS id, round(sum(d), 6) AS total FROM s WHERE ga = gb GROUP BY 1, 2)
    SELECT g, id, total FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY total, id) AS r FROM t) WHERE r = 1""")
def medoid_per_label(spark, sf_dir):
    return spatial.group_medoids(_vectors(spark, sf_dir)).withColumnRenamed("group", "g")


@query(f"""WITH {_BOTH}, m AS (SELECT a, ga, gb, avg(d) AS mean FROM s GROUP BY 1, 2, 3),
    q AS (SELECT a, ga, max(mean) FILTER (ga = gb) AS i, min(mean) FILTER (ga <> gb) AS o FROM m GROUP BY 1, 2)
    SELECT ga AS g, round(avg(CASE WHEN i IS NULL THEN 0 ELSE (o - i) / greatest(i, o) END), 6) AS silhouette FROM q GROUP BY 1""")
def silhouette_per_label(spark, sf_dir):
    s = spatial.group_silhouettes(_vectors(spark, sf_dir))
    return s.groupBy(F.col("group").alias("g")).agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query(f"""WITH RECURSIVE {_PAIRS}, l AS (SELECT a, b FROM p WHERE d <= 1.0501 UNION SELECT b, a FROM p WHERE d <= 1.0501),
    r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT a AS id, min(b) AS component FROM r GROUP BY a""")
def graph_components(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "v")
    found = connected_components(spatial.linking_edges(v, 1.0501))
    return v.join(found, v.id == found.node, "left").select("id", F.coalesce("component", "id").alias("component"))


_POINTS = "SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(12)) + " FROM embeddings"
_AXES = ("x", "y", "z")


def _cross_sql(a: str, b: str) -> list[str]:
    return [f"({a}{(k + 1) % 3} * {b}{(k + 2) % 3} - {a}{(k + 2) % 3} * {b}{(k + 1) % 3})" for k in range(3)]


_STEPS = ", ".join(f"x{3 * s + 3 + k} - x{3 * s + k} AS {'abc'[s]}{k}" for s in range(3) for k in range(3))
_NORMALS = ", ".join(f"{e} AS {n}{k}" for n, (p, q) in (("m", "ab"), ("n", "bc")) for k, e in enumerate(_cross_sql(p, q)))
_TORSION = f"""WITH x AS ({_POINTS}), d AS (SELECT id, {_STEPS} FROM x), n AS (SELECT *, {_NORMALS} FROM d),
    t AS (SELECT id, atan2(sqrt(b0 * b0 + b1 * b1 + b2 * b2) * (a0 * n0 + a1 * n1 + a2 * n2), m0 * n0 + m1 * n1 + m2 * n2) AS t,
        acos(greatest(-1, least(1, (a0 * b0 + a1 * b1 + a2 * b2) / (sqrt(a0 * a0 + a1 * a1 + a2 * a2) * sqrt(b0 * b0 + b1 * b1 + b2 * b2))))) AS angle,
        acos(greatest(-1, least(1, (m0 * n0 + m1 * n1 + m2 * n2) / (sqrt(m0 * m0 + m1 * m1 + m2 * m2) * sqrt(n0 * n0 + n1 * n1 + n2 * n2))))) AS planes FROM n)"""


@query(f"{_TORSION} SELECT id, round(t, 6) AS torsion FROM t")
def torsion_iupac(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(geometry.torsion(*map(_point, range(4))), 6).alias("torsion"))


@query(f"{_TORSION} SELECT id, round(-t, 6) AS torsion FROM t")
def torsion_flipped(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(geometry.torsion_flipped(*map(_point, range(4))), 6).alias("torsion"))


@query(f"{_TORSION} SELECT id, round(angle, 6) AS angle FROM t")
def vector_angle(spark, sf_dir):
    p = [_point(i) for i in range(3)]
    return _vectors(spark, sf_dir).select("id", F.round(geometry.vector_angle(geometry.minus(p[1], p[0]), geometry.minus(p[2], p[1])), 6).alias("angle"))


@query(f"{_TORSION} SELECT id, round(planes, 6) AS angle FROM t")
def plane_angle(spark, sf_dir):
    p = [_point(i) for i in range(4)]
    steps = [geometry.minus(p[i + 1], p[i]) for i in range(3)]
    return _vectors(spark, sf_dir).select("id", F.round(geometry.vector_angle(geometry.cross(steps[0], steps[1]), geometry.cross(steps[1], steps[2])), 6).alias("angle"))


@query(f"{_TORSION} SELECT id, CASE WHEN t > radians(-30) AND t < radians(120) THEN 'syn' ELSE 'anti' END AS chi_class, CASE WHEN t > -pi() / 2 AND t < pi() / 2 THEN 'c' ELSE 't' END AS side FROM t")
def glycosidic_and_side(spark, sf_dir):
    t = geometry.torsion(*map(_point, range(4)))
    return _vectors(spark, sf_dir).select("id", geometry.glycosidic_class(t).alias("chi_class"), geometry.cis_trans(t).alias("side"))


@query("SELECT label AS g, i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2")
def centroid_per_label(spark, sf_dir):
    means = spatial.centroids(_vectors(spark, sf_dir))
    return means.select(F.col("group").alias("g"), F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < 10 THEN exp(-power((l_quantity - 10) / 5, 2) / 2)
    WHEN l_quantity > 30 THEN exp(-power((l_quantity - 30) / 5, 2) / 2) ELSE 1 END, 6) AS density FROM lineitem""")
def plateau_density(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(geometry.plateau(F.col("l_quantity"), 10, 30, 5), 6).alias("density"))


_ANGLE = "radians(15.0 * extract(hour FROM ts) + 0.25 * extract(minute FROM ts))"


def _angle() -> Column:
    return F.radians(F.lit(15.0) * F.hour("ts") + F.lit(0.25) * F.minute("ts"))


@query(f"""SELECT event_type, round(atan2(sum(sin(a)), sum(cos(a))), 6) AS mean, round(sqrt(power(avg(sin(a)), 2) + power(avg(cos(a)), 2)), 6) AS resultant
    FROM (SELECT event_type, {_ANGLE} AS a FROM events) GROUP BY 1""")
def circular_mean_by_type(spark, sf_dir):
    a = F.col("a")
    return _read(spark, sf_dir, "events").select("event_type", _angle().alias("a")).groupBy("event_type").agg(F.round(circular.circular_mean(a), 6).alias("mean"), F.round(circular.resultant_length(a), 6).alias("resultant"))


@query(f"""SELECT event_id, round(atan2(sin(a - b), cos(a - b)), 6) AS turn FROM (
    SELECT event_id, a, lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, {_ANGLE} AS a FROM events))""")
def wrapped_difference(spark, sf_dir):
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = _read(spark, sf_dir, "events").withColumn("a", _angle())
    return events.select("event_id", F.round(circular.wrap(F.col("a") - F.lag("a").over(window)), 6).alias("turn"))


@query(f"""WITH e AS (SELECT event_type, {_ANGLE} AS a FROM events), m AS (SELECT event_type, atan2(sum(sin(a)), sum(cos(a))) AS c FROM e GROUP BY 1)
    SELECT event_type, round(median(abs(atan2(sin(a - c), cos(a - c)))), 6) AS mad FROM e JOIN m USING (event_type) GROUP BY 1""")
def circular_mad_by_type(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_type", _angle().alias("a"))
    centers = e.groupBy("event_type").agg(circular.circular_mean(F.col("a")).alias("c"))
    return e.join(centers, "event_type").groupBy("event_type").agg(F.round(circular.circular_mad(F.col("a"), F.col("c")), 6).alias("mad"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS s
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM e)
    SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY 1, 2, 3""")
def run_length_groups(spark, sf_dir):
    marked = groups.runs(_read(spark, sf_dir, "events"), ["event_type"], ["user_id"], ["ts", "event_id"])
    return marked.groupBy("user_id", F.col("run").cast("long").alias("run"), "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def keep_best_duplicate(spark, sf_dir):
    best = groups.keep_first(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    return best.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("""WITH e AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS s
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM e)
    SELECT user_id, segment, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY 1, 2""")
def segments_by_gap(spark, sf_dir):
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(window), F.col("ts")) > 3_600_000_000
    marked = groups.segments(_read(spark, sf_dir, "events"), gap, ["user_id"], ["ts", "event_id"])
    return marked.groupBy("user_id", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_STEMS = "SELECT DISTINCT l_orderkey % 50 AS g, l_linenumber + 7 * (l_partkey % 40) AS i, 1000 - l_linenumber - 7 * (l_partkey % 40) - (l_partkey % 3) AS j FROM lineitem WHERE l_quantity > 25"


@query(f"""WITH p AS (SELECT g, i, min(j) AS j FROM ({_STEMS}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g, i + j ORDER BY i) AS r FROM p)
    SELECT g, min(i) AS i, max(j) AS j, count(*) AS length FROM r GROUP BY g, i + j, i - r""")
def stem_runs(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").where("l_quantity > 25")
    pairs = lines.selectExpr("l_orderkey % 50 AS g", "l_linenumber + 7 * (l_partkey % 40) AS i", "1000 - l_linenumber - 7 * (l_partkey % 40) - (l_partkey % 3) AS j")
    return groups.stem_runs(pairs.groupBy("g", "i").agg(F.min("j").alias("j")), ["g"])


@query("""WITH o AS (SELECT o_custkey AS g, o_orderkey AS id, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS i FROM orders), q AS (SELECT *, i + 30 + id % 90 AS j FROM o)
    SELECT a.g AS g, a.id AS first, b.id AS second FROM q a JOIN q b ON a.g = b.g AND a.i < b.i AND b.i < a.j AND a.j < b.j""")
def conflict_pairs(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("i"))
    return groups.crossing_pairs(o.withColumn("j", F.col("i") + 30 + F.col("id") % 90), ["g"])


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (
    SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')))""")
def closure_filter(spark, sf_dir):
    tables = {t: _read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders")}
    links = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")]
    return categories.closure(tables, links, {"region": tables["region"].where("r_name = 'EUROPE'")})["orders"].select("o_orderkey")


@query("SELECT DISTINCT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 10 AND 20")
def select_ids(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    by_brand = categories.select_ids(_as_category(part, "part"), "part", "p_brand", ["Brand#1", "Brand#2"], "p_partkey")
    by_size = categories.select_ids(_as_category(part, "part"), "part", "p_size", [str(n) for n in range(10, 21)], "p_partkey")
    return by_brand.join(by_size, ["path", "id"], "left_semi").select(F.col("id").cast("long").alias("p_partkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2'))")
def category_by_id(spark, sf_dir):
    ids = categories.select_ids(_as_category(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "part"), "part", "p_brand", ["Brand#1", "Brand#2"], "p_partkey")
    lines = _as_category(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "lineitem")
    kept = categories.keep_ids(lines, ids, (("lineitem", "l_partkey"),))
    return kept.select(*[categories.item(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")])


@query("""SELECT event_id, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(code AS INTEGER), 1) AS code FROM events JOIN (
    SELECT event_type, row_number() OVER (ORDER BY first) AS code FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)) USING (event_type)""")
def replace_by_first_seen(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "event_type")
    codes = groups.by_first_seen(events, "event_type", "event_id")
    return events.join(codes, "event_type").select("event_id", F.expr("substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', code, 1)").alias("code"))


@query("""SELECT conv_id, role, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS r FROM (
    SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1, 2)) WHERE r = 1""")
def most_common_identifier(spark, sf_dir):
    return groups.most_common(_read(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (
    SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE n >= 2) WHERE r = 1""")
def category_vote(spark, sf_dir):
    votes = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 2")
    return groups.keep_first(votes, ["user_id"], [F.desc("n"), F.asc("event_type")])


@query("""SELECT n_nationkey, coalesce(c, 'none') AS class FROM nation LEFT JOIN (VALUES (0, 'XIX'), (1, 'XX'), (3, 'XXVIII')) t(k, c) ON n_regionkey = k""")
def lookup_class(spark, sf_dir):
    table = {0: "XIX", 1: "XX", 3: "XXVIII"}
    return _read(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(chemistry.lookup(F.col("n_regionkey"), table), F.lit("none")).alias("class"))


@query("""WITH c AS (SELECT l_orderkey AS g, list_sort(list_distinct(list(CAST(l_linenumber + l_partkey % 4 AS BIGINT)))) AS c FROM lineitem GROUP BY 1),
    d AS (SELECT g, CASE WHEN list_contains(c, 3) AND list_contains(c, 5) THEN list_append(list_filter(c, lambda x: x NOT IN (3, 5, 4)), 4) ELSE c END AS c FROM c),
    e AS (SELECT g, CASE WHEN list_contains(c, 7) AND list_contains(c, 9) THEN list_append(list_filter(c, lambda x: x NOT IN (7, 9, 8)), 8) ELSE c END AS c FROM d)
    SELECT g, c[1] AS code FROM e""")
def merge_codes(spark, sf_dir):
    codes = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.collect_set((F.col("l_linenumber") + F.col("l_partkey") % 4).cast("long")).alias("c"))
    return codes.select("g", groups.merge_codes(F.col("c")).alias("code"))


@query("SELECT p_partkey, replace(upper(p_name), 'T', 'U') AS sequence FROM part")
def fasta_normalise(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", secondary_text.normalised(F.col("p_name")).alias("sequence"))


@query(r"SELECT item_id, regexp_replace(text, '[\[\]{}<>A-Za-z]', '.', 'g') AS structure FROM benchmark")
def strip_brackets(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", secondary.strip_pseudoknots(F.col("text")).alias("structure"))


@query("SELECT p_partkey, concat(substr(p_type, 1, 1), '.', p_brand, CASE WHEN regexp_matches(p_brand, '[0-9]$') THEN '/' ELSE '' END, p_size, CASE WHEN p_size % 7 = 0 THEN concat('^', substr(p_name, 1, 1)) ELSE '' END) AS full_name FROM part")
def full_name(spark, sf_dir):
    from helixframe.functions.residues import full_name as name

    part = _read(spark, sf_dir, "part")
    icode = F.when(F.col("p_size") % 7 == 0, F.substring("p_name", 1, 1))
    return part.select("p_partkey", name(F.substring("p_type", 1, 1), F.col("p_brand"), F.col("p_size"), icode).alias("full_name"))


@query("SELECT l_orderkey AS serial, l_linenumber AS residue_number, round(l_quantity, 3) AS x, round(l_discount, 3) AS y, round(l_tax, 3) AS z FROM lineitem")
def fixed_width_parse(spark, sf_dir):
    from helixframe.sources.pdb import atom_line, parse_atom_lines

    line = atom_line(record=F.lit("ATOM"), serial=F.col("l_orderkey"), name=F.lit("P"), alt=F.lit(None), residue=F.lit("A"), chain=F.lit("A"), number=F.col("l_linenumber"), icode=F.lit(None), x=F.col("l_quantity"), y=F.col("l_discount"), z=F.col("l_tax"), occupancy=F.lit(1.0), b=F.lit(0.0), element=F.lit("P"), charge=F.lit(None))
    lines = _read(spark, sf_dir, "lineitem").select(line.alias("value"))
    atoms = parse_atom_lines(lines.withColumn("path", F.lit("x")).withColumn("line_number", F.lit(0)))
    return atoms.select(F.col("serial").cast("long").alias("serial"), "residue_number", "x", "y", "z")


_BASE36 = " || ".join(f"substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((l_orderkey - 100000 + 16796160) // {36**k} % 36 AS INTEGER) + 1, 1)" for k in range(4, -1, -1))


@query(f"""SELECT l_orderkey, l_linenumber, concat('ATOM  ', CASE WHEN l_orderkey < 100000 THEN lpad(CAST(l_orderkey AS VARCHAR), 5, ' ') ELSE {_BASE36} END, '  P   ', lpad('A', 3, ' '), ' A', lpad(CAST(l_linenumber AS VARCHAR), 4, ' '), '    ',
    lpad(printf('%.3f', l_quantity), 8, ' '), lpad(printf('%.3f', l_discount), 8, ' '), lpad(printf('%.3f', l_tax), 8, ' '), '  1.00', '  0.00', '          ', ' P', '  ') AS line FROM lineitem""")
def format_pdb_line(spark, sf_dir):
    from helixframe.sources.pdb import atom_line

    line = atom_line(record=F.lit("ATOM"), serial=F.col("l_orderkey"), name=F.lit("P"), alt=F.lit(None), residue=F.lit("A"), chain=F.lit("A"), number=F.col("l_linenumber"), icode=F.lit(None), x=F.col("l_quantity"), y=F.col("l_discount"), z=F.col("l_tax"), occupancy=F.lit(1.0), b=F.lit(0.0), element=F.lit("P"), charge=F.lit(None))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))


@query("""SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY first) AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS serial FROM (
    SELECT o_orderkey, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM orders)""")
def renumber_to_limits(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    atoms = orders.select(F.col("o_custkey").cast("string").alias("path"), F.lit(1).alias("model"), F.lit("long name").alias("chain_id"), F.lit(0).alias("residue_number"), F.lit("x").alias("insertion_code"), F.col("o_orderpriority").alias("residue_name"), F.lit(0).alias("serial"), F.col("o_orderkey").alias("line_number"))
    fitted = structure.fit_to_pdb(atoms)
    return fitted.select(F.col("line_number").alias("o_orderkey"), F.col("residue_number").cast("long").alias("number"), F.col("serial").cast("long").alias("serial"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def adapter_json(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT user_id, event_type, max(value) AS most, count(*) AS n FROM events GROUP BY 1, 2")
def clash_rollup(spark, sf_dir):
    found = _read(spark, sf_dir, "events").withColumnRenamed("value", "occupancy")
    return structure.clash_rollup(found, ["user_id", "event_type"]).withColumnRenamed("occupancy", "most")


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.08 AS valid FROM lineitem")
def threshold_predicates(spark, sf_dir):
    from helixframe.functions.residues import in_ranges

    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", in_ranges({"l_quantity": (10, 20), "l_discount": (0.02, 0.08)}).alias("valid"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IS NULL OR l_returnflag IN ('', '.', '?', 'A')")
def altloc_default(spark, sf_dir):
    from helixframe.functions.residues import default_altloc

    return _read(spark, sf_dir, "lineitem").where(default_altloc(F.col("l_returnflag"))).select("l_orderkey", "l_linenumber")


@query(f"""WITH {_BOTH}, t AS (SELECT a, round(sum(1 / (1 + d)), 6) AS gain FROM s GROUP BY 1) SELECT a AS id, gain FROM t ORDER BY gain DESC, a LIMIT 1""")
def facility_first_pick(spark, sf_dir):
    return distill.greatest_gains(_vectors(spark, sf_dir).select("id", "v")).orderBy(F.desc("gain"), "id").limit(1)


@query("""WITH t AS (SELECT o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS gain FROM orders GROUP BY 1)
    SELECT o_orderpriority, gain, CAST(sum(gain) OVER w AS BIGINT) AS cumulative, CAST(sum(gain) OVER () - sum(gain) OVER w AS BIGINT) AS remaining
    FROM t WINDOW w AS (ORDER BY gain DESC, o_orderpriority ROWS UNBOUNDED PRECEDING)""")
def gain_curve(spark, sf_dir):
    t = _read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("gain"))
    return distill.gain_curve(t, order=[F.desc("gain"), F.asc("o_orderpriority")])


FLAGSHIP = "run_length_groups"

from helixframe import catalog_structures  # noqa: E402, F401  registers its queries here
