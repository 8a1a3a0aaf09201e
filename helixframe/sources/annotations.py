"""Outputs of annotation tools as one table of interactions, with built-in functions.

Columns: path, tool, kind (base-pair, stacking, base-phosphate, base-ribose, other), chain_k, number_k, icode_k, name_k for k = 1, 2,
lw, saenger, topology and code (the tool's own class); what a tool does not tell is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import cif
from helixframe.sources.pdb import scan_lines

# Classes of the tools.
TWELVE = ("cWW", "tWW", "cWH", "tWH", "cWS", "tWS", "cHH", "tHH", "cHS", "tHS", "cSS", "tSS")
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX", "XXI", "XXII", "XXIII", "XXIV", "XXV", "XXVI", "XXVII", "XXVIII")
FR3D_STACKS = {"s33": "downward", "s55": "upward", "s35": "outward", "s53": "inward"}
#: Lines of BPNet's .rob files: adjacent and other stacking and adjacent contacts; parts of a nucleotide by atom.
ROB_STACKS = ("ASTK", "OSTK", "ADJA")
ROB_PHOSPHATE = ("P", "OP1", "OP2", "O5'", "C5'", "C4'", "C3'", "O3'", "O5*", "C5*", "C4*", "C3*", "O3*")
ROB_RIBOSE = ("C1'", "C2'", "O2'", "O4'", "C1*", "C2*", "O2*", "O4*")
ROB_BASE = ("C2", "C4", "C5", "C6", "C8", "N1", "N2", "N3", "N4", "N6", "N7", "N9", "O2", "O4", "O6")
COLUMNS = ["path", "tool", "kind", *[f"{c}_{k}" for k in (1, 2) for c in ("chain", "number", "icode", "name")], "lw", "saenger", "topology", "code"]
TYPES = {"number_1": "int", "number_2": "int"}


def unified(rows: DataFrame, tool: str) -> DataFrame:
    rows = rows.withColumn("tool", F.lit(tool))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS])


def lw_text(value: Column) -> Column:
    """Leontis-Westhof class in its usual letter case, null where the text is none."""
    good = F.regexp_extract(value, r"^([ctCT])([WHSwhs])([WHSwhs])$", 0) != ""
    return F.when(good, F.concat(F.lower(F.substring(value, 1, 1)), F.upper(F.substring(value, 2, 2))))


def detect_tool(name: Column, head: Column) -> Column:
    """The tool that a file's name or first line points to."""
    return (
        F.when(name.endswith("basepair_detail.txt"), "fr3d")
        .when(name.endswith(".out"), "rnaview")
        .when(name.endswith("basepair.json"), "bpnet")
        .when(name.endswith("stdout.txt"), "mc-annotate")
        .when(name.rlike(r"(pairing|stacking)[^/]*$"), "barnaba")
        .when(name.endswith(".json"), "dssr")
        .when(head.contains("ntC") & head.contains(","), "dnatco")
        .otherwise("maxit")
    )


def read_fr3d(spark: SparkSession, path: str) -> DataFrame:
    return parse_fr3d(scan_lines(spark, path))


def parse_fr3d(lines: DataFrame) -> DataFrame:
    """(path, value) lines: tab-separated rows of two unit ids and a class; near classes (n) count, a trailing a is dropped."""
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 3).select("path", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("one", "code", "two"))])
    for k, unit in ((1, "one"), (2, "two")):
        fields = F.split(unit, r"\|")
        icode = F.get(fields, F.lit(7))
        rows = rows.withColumn(f"chain_{k}", F.get(fields, F.lit(2))).withColumn(f"name_{k}", F.get(fields, F.lit(3))).withColumn(f"number_{k}", F.get(fields, F.lit(4)).try_cast("int")).withColumn(f"icode_{k}", F.when(icode != "", icode))
    plain = F.regexp_replace(F.regexp_replace(F.trim("code"), "^n", ""), "a$", "")
    stack = F.try_element_at(F.create_map(*[F.lit(x) for kv in FR3D_STACKS.items() for x in kv]), plain)
    phosphate, ribose = plain.rlike(r"^[0-9]BPh$"), plain.rlike(r"^[0-9]BR$")
    kind = F.when(stack.isNotNull(), "stacking").when(lw_text(plain).isNotNull(), "base-pair").when(phosphate, "base-phosphate").when(ribose, "base-ribose").otherwise("other")
    return unified(rows.withColumns({"kind": kind, "lw": lw_text(plain), "topology": stack}).where("number_1 is not null and number_2 is not null"), "fr3d")


def read_maxit(spark: SparkSession, path: str) -> DataFrame:
    """The base-pair category of mmCIF files, classes by their two numbers."""
    items = ["i_auth_asym_id", "i_auth_seq_id", "i_PDB_ins_code", "i_label_comp_id", "j_auth_asym_id", "j_auth_seq_id", "j_PDB_ins_code", "j_label_comp_id", "hbond_type_28", "hbond_type_12"]
    rows = cif.category(cif.read_categories(spark, path), "ndb_struct_na_base_pair", items)
    names = dict(zip(("chain", "number", "icode", "name"), ("auth_asym_id", "auth_seq_id", "PDB_ins_code", "label_comp_id")))
    for k, side in ((1, "i"), (2, "j")):
        for new, old in names.items():
            rows = rows.withColumn(f"{new}_{k}", F.col(f"{side}_{old}").try_cast("int") if new == "number" else F.col(f"{side}_{old}"))
    pick = lambda table, c: F.get(F.array(*map(F.lit, table)), F.col(c).try_cast("int") - 1)
    rows = rows.withColumns({"lw": pick(TWELVE, "hbond_type_12"), "saenger": pick(ROMAN, "hbond_type_28"), "code": F.concat_ws("/", "hbond_type_12", "hbond_type_28")})
    return unified(rows.withColumn("kind", F.when(F.col("lw").isNull() & F.col("saenger").isNull(), "other").otherwise("base-pair")), "maxit")


def _known(value: Column) -> Column:
    return F.when(~F.trim(value).isin("", "?", "."), value)


def read_bpnet(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of BPNet's JSON and the contacts of its .rob files, by file name; edges + z g stand for W S H."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    schema = "basepairs array<struct<resnum1:int,chain1:string,ins1:string,resname1:string,resnum2:int,chain2:string,ins2:string,resname2:string,basepair:string>>"
    rows = files.where(~F.col("path").endswith(".rob")).select("path", F.explode(F.from_json("value", schema)["basepairs"]).alias("b"))
    code = F.translate(F.col("b.basepair"), "+zg", "WSH")
    lw = lw_text(F.concat(F.substring(code, 4, 1), F.substring(code, 1, 1), F.substring(code, 3, 1)))
    fields = {f"{n}_{k}": F.col(f"b.{o}{k}") for k in (1, 2) for n, o in (("chain", "chain"), ("number", "resnum"), ("icode", "ins"), ("name", "resname"))}
    rows = rows.withColumns(fields).withColumns({f"{n}_{k}": _known(F.col(f"{n}_{k}")) for k in (1, 2) for n in ("chain", "icode")})
    rows = rows.withColumns({"lw": lw, "code": F.col("b.basepair")})
    rows = rows.withColumn("kind", F.when(F.col("lw").isNull(), "other").otherwise("base-pair"))
    lines = files.where(F.col("path").endswith(".rob")).select("path", F.explode(F.split("value", r"\r?\n")).alias("value"))
    return unified(rows, "bpnet").unionByName(unified(_rob_contacts(lines), "bpnet"))


def _rob_contacts(lines: DataFrame) -> DataFrame:
    """Contacts of (path, value): OVLP lines of 13 fields and PROX lines of 11; a base comes before its backbone.

    Each PROX line gives an 'other' contact too, as its atoms lie near whatever else they do.
    """
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get("f", F.lit(i))
    rows = lines.withColumn("f", f).where((F.col("value").startswith("OVLP") & (F.size("f") == 13) & at(7).isin(*ROB_STACKS)) | (F.col("value").startswith("PROX") & (F.size("f") == 11)))
    half = lambda i, sep, k: F.get(F.split(at(i), sep), F.lit(k))
    sides = [F.struct(_known(half(6, r"\^", k)).alias("chain"), half(3, ":", k).try_cast("int").alias("number"), _known(at(2 + 2 * k)).alias("icode"), half(5, ":", k).alias("name")) for k in (0, 1)]
    part = lambda a: F.when(a.isin(*ROB_PHOSPHATE), "phosphate").when(a.isin(*ROB_RIBOSE), "ribose").when(a.isin(*ROB_BASE), "base")
    rows = rows.select("path", at(0).alias("record"), at(7).alias("code"), sides[0].alias("one"), sides[1].alias("two"), part(half(7, ":", 0)).alias("p1"), part(half(7, ":", 1)).alias("p2"))
    rows = rows.where("one.number is not null and two.number is not null")
    turned = F.coalesce(F.col("p1").isin("ribose", "phosphate") & (F.col("p2") == "base"), F.lit(False))
    forward = F.coalesce(F.col("p2").isin("ribose", "phosphate") & (F.col("p1") == "base"), F.lit(False))
    contact = F.struct(F.when(forward, F.concat(F.lit("base-"), "p2")).when(turned, F.concat(F.lit("base-"), "p1")).alias("kind"), F.when(turned, F.col("two")).otherwise(F.col("one")).alias("one"), F.when(turned, F.col("one")).otherwise(F.col("two")).alias("two"))
    plain = lambda kind: F.struct(F.lit(kind).alias("kind"), "one", "two")
    found = F.when(F.col("record") == "OVLP", F.array(plain("stacking"))).otherwise(F.filter(F.array(contact, plain("other")), lambda x: x["kind"].isNotNull()))
    rows = rows.select("path", "code", F.explode(found).alias("c"))
    return rows.select("path", "code", "c.kind", *[F.col(f"c.{unit}.{n}").alias(f"{n}_{k}") for k, unit in ((1, "one"), (2, "two")) for n in ("chain", "number", "icode", "name")])


def read_dssr(spark: SparkSession, path: str, model: int | None = None) -> DataFrame:
    return parse_dssr(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), model)


def parse_dssr(texts: DataFrame, model: int | None = None) -> DataFrame:
    """(path, value) texts: pairs and the consecutive members of stacks of DSSR's JSON.

    Of a file of many models the asked one is read, by default the first; a file without the asked one gives no row.
    """
    result = "pairs array<struct<nt1:string,nt2:string,LW:string,Saenger:string>>, stacks array<struct<nts_long:string>>"
    schema = f"{result}, models array<struct<model:int,parameters:struct<{result.replace(' array', ':array')}>>>"
    files = texts.select("path", F.from_json("value", schema).alias("j"))
    models = F.col("j.models") if model is None else F.filter("j.models", lambda m: m["model"] == model)
    chosen = F.get(models, F.lit(0))["parameters"]
    files = files.select("path", F.when(F.col("j.models").isNull(), F.struct("j.pairs", "j.stacks")).otherwise(F.struct(chosen["pairs"].alias("pairs"), chosen["stacks"].alias("stacks"))).alias("j"))
    pairs = files.select("path", F.explode("j.pairs").alias("b")).select("path", F.lit("base-pair").alias("kind"), F.col("b.nt1").alias("one"), F.col("b.nt2").alias("two"), lw_text(F.col("b.LW")).alias("lw"), F.col("b.LW").alias("code"))
    members = files.select("path", F.posexplode("j.stacks").alias("s", "b")).select("path", "s", F.split("b.nts_long", ",").alias("n"))
    steps = members.select("path", F.explode(F.arrays_zip(F.expr("slice(n, 1, size(n) - 1)").alias("one"), F.expr("slice(n, 2, size(n))").alias("two"))).alias("z"))
    stacks = steps.select("path", F.lit("stacking").alias("kind"), "z.one", "z.two", F.lit(None).cast("string").alias("lw"), F.lit(None).cast("string").alias("code")).where("one is not null and two is not null")
    rows = pairs.withColumn("kind", F.when(F.col("lw").isNull(), "other").otherwise(F.col("kind"))).unionByName(stacks)
    pattern = r"^(?:\d+:)?(?:([^.]*)\.)?(.*?[A-Za-z]|.*?/)(-?\d+)(?:\^(.))?$"
    for k, unit in ((1, "one"), (2, "two")):
        get = lambda g, u=unit: F.regexp_extract(u, pattern, g)
        rows = rows.withColumns({f"chain_{k}": get(1), f"name_{k}": F.regexp_replace(get(2), "/$", ""), f"number_{k}": get(3).try_cast("int"), f"icode_{k}": F.when(get(4) != "", get(4))})
    return unified(rows, "dssr")
