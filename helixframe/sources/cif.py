"""mmCIF files: a tokenizer over Arrow batches makes one row per category row; the rest is built-in functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.residues import null_marker

SCHEMA = "path string, block string, category string, row_idx int, attrs map<string,string>"
#: A text field between semicolons at line starts, a quoted value, a comment, or a bare word.
TOKEN = re.compile(r"^;(?P<text>.*?)\n;(?=\s|\Z)|'(?P<one>(?:[^'\n]|'(?=\S))*)'(?=\s|\Z)|\"(?P<two>(?:[^\"\n]|\"(?=\S))*)\"(?=\s|\Z)|(?P<note>\#[^\n]*)|(?P<bare>\S+)", re.S | re.M)


def tokens(content: str) -> Iterator[tuple[str, bool]]:
    """(value, quoted) in order."""
    for m in TOKEN.finditer(content.replace("\r\n", "\n")):
        kind = m.lastgroup
        if kind != "note":
            yield m[kind], kind != "bare"


def rows(content: str) -> Iterator[tuple[str, str, int, dict[str, str]]]:
    """(block, category, row number, values by item) of a file, single values as a loop of one row."""
    block, single, order = "", {}, []
    stream = list(tokens(content))
    at = 0

    def flush():
        for category in order:
            yield block, category, 0, single[category]
        single.clear()
        order.clear()

    def is_word(k: int) -> bool:
        if k >= len(stream) or stream[k][1]:
            return True
        low = stream[k][0].lower()
        return low.startswith(("_", "data_", "save_")) or low == "loop_"

    while at < len(stream):
        value, quoted = stream[at]
        low = value.lower()
        if not quoted and low.startswith("data_"):
            yield from flush()
            block = value[5:]
            at += 1
        elif not quoted and low == "loop_":
            names = []
            at += 1
            while at < len(stream) and not stream[at][1] and stream[at][0].startswith("_"):
                names.append(stream[at][0])
                at += 1
            values = []
            while at < len(stream) and (stream[at][1] or not is_word(at)):
                values.append(stream[at][0])
                at += 1
            if names:
                category = names[0].partition(".")[0].lstrip("_")
                items = [n.partition(".")[2] or n for n in names]
                for k in range(len(values) // len(items)):
                    yield block, category, k, dict(zip(items, values[k * len(items) : (k + 1) * len(items)]))
        elif not quoted and value.startswith("_") and at + 1 < len(stream):
            category, _, item = value.lstrip("_").partition(".")
            if category not in single:
                single[category] = {}
                order.append(category)
            single[category][item or category] = stream[at + 1][0]
            at += 2
        else:
            at += 1
    yield from flush()


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """All category rows of mmCIF files (gzipped or not), values as text, null markers kept."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches):
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(rows(content or ""))
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part], pa.int32()), pa.array([list(r[3].items()) for r in part], kind)],
                        names=["path", "block", "category", "row_idx", "attrs"],
                    )

    return files.mapInArrow(run, SCHEMA)


def category(categories: DataFrame, name: str, items: list[str]) -> DataFrame:
    """One category as a table of the given items, ? and . as null."""
    return categories.where(F.col("category") == name).select("path", "row_idx", *[null_marker(F.try_element_at("attrs", F.lit(i))).alias(i) for i in items])


def list_categories(categories: DataFrame) -> DataFrame:
    return categories.select("path", "category").distinct()


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """atom_site in the schema of the PDB reader; author columns where the row's file has them, else label columns."""
    site = read_categories(spark, path).where("category = 'atom_site'")

    def item(name: str) -> Column:
        return null_marker(F.try_element_at("attrs", F.lit(name)))

    def either(kind: str) -> Column:
        has = F.map_contains_key("attrs", f"auth_{kind}")
        return F.when(has, item(f"auth_{kind}")).otherwise(item(f"label_{kind}"))

    return site.select(
        "path", "row_idx", item("group_PDB").alias("record_type"), item("id").try_cast("int").alias("serial"), either("atom_id").alias("atom_name"), item("label_alt_id").alias("alt_loc"),
        either("comp_id").alias("residue_name"), either("asym_id").alias("chain_id"), either("seq_id").try_cast("int").alias("residue_number"), item("pdbx_PDB_ins_code").alias("insertion_code"),
        *[item(f"Cartn_{a}").try_cast("double").alias(a) for a in "xyz"], item("occupancy").try_cast("double").alias("occupancy"), item("B_iso_or_equiv").try_cast("double").alias("b_factor"),
        item("type_symbol").alias("element"), item("pdbx_formal_charge").alias("charge"), F.coalesce(item("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model"),
    )


def standard_names(spark: SparkSession, path: str) -> DataFrame:
    """Standard names of residues, keyed as in read_atoms: the letter of the entity's sequence, else the modification's parent."""
    rows = read_categories(spark, path)
    item = lambda name: null_marker(F.try_element_at("attrs", F.lit(name)))

    def either(kind: str, old: str) -> Column:
        return F.when(F.map_contains_key("attrs", f"auth_{kind}"), item(f"auth_{kind}")).otherwise(item(old))

    residue = [either("asym_id", "label_asym_id").alias("chain_id"), either("seq_id", "label_seq_id").try_cast("int").alias("residue_number")]
    name = either("comp_id", "label_comp_id").alias("residue_name")
    site = rows.where("category = 'atom_site'").select("path", *residue, item("pdbx_PDB_ins_code").alias("insertion_code"), name, item("label_entity_id").alias("entity"), item("label_seq_id").try_cast("int").alias("place")).distinct()
    poly = rows.where("category = 'entity_poly'").select("path", item("entity_id").alias("entity"), F.regexp_replace(item("pdbx_seq_one_letter_code_can"), r"\s", "").alias("sequence"))
    letter = F.when(F.col("place") >= 1, F.expr("substring(sequence, place, 1)"))
    listed = site.join(poly, ["path", "entity"]).withColumn("standard_name", letter).where("standard_name in ('A', 'C', 'G', 'U', 'T')")
    keys = ["path", "chain_id", "residue_number", "insertion_code", "residue_name"]
    changed = rows.where("category = 'pdbx_struct_mod_residue'").select("path", *residue, item("PDB_ins_code").alias("insertion_code"), name, item("parent_comp_id").alias("standard_name"))
    both = listed.select(*keys, "standard_name", F.lit(0).alias("rank")).unionByName(changed.where("standard_name is not null").select(*keys, "standard_name", F.lit(1).alias("rank")))
    return both.groupBy(*keys).agg(F.min_by("standard_name", "rank").alias("standard_name"))


def quote(value: Column) -> Column:
    """A value as mmCIF text: null as ?, quoted where it needs to be."""
    risky = value.rlike(r"\s|^[_#$'\"\[\];]|^(?i)(data_|loop_|save_|stop_|global_)") | (value == "")
    return F.when(value.isNull(), F.lit("?")).when(risky & ~value.contains('"'), F.concat(F.lit('"'), value, F.lit('"'))).when(risky, F.concat(F.lit("'"), value, F.lit("'"))).otherwise(value)


def write_category(table: DataFrame, name: str, items: list[str], order: str = "row_idx") -> DataFrame:
    """(path, content): each file's loop of one category as text, rows in order."""
    line = F.concat_ws(" ", *[quote(F.col(i).cast("string")) for i in items])
    head = "loop_\n" + "\n".join(f"_{name}.{i}" for i in items) + "\n"
    texts = table.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("lines"))
    return texts.select("path", F.concat(F.lit(head), F.array_join(F.col("lines.line"), "\n"), F.lit("\n#\n")).alias("content"))


#: Items of atom_site and the columns of the PDB reader that they are written from; None: the same for all atoms.
SITE_ITEMS = (
    ("group_PDB", "record_type"), ("id", "serial"), ("type_symbol", "element"), ("label_atom_id", "atom_name"), ("label_alt_id", "alt_loc"), ("label_comp_id", "residue_name"), ("label_asym_id", "chain_id"),
    ("label_entity_id", None), ("label_seq_id", "residue_number"), ("pdbx_PDB_ins_code", "insertion_code"), ("Cartn_x", "x"), ("Cartn_y", "y"), ("Cartn_z", "z"), ("occupancy", "occupancy"),
    ("B_iso_or_equiv", "b_factor"), ("pdbx_formal_charge", "charge"), ("auth_seq_id", "residue_number"), ("auth_comp_id", "residue_name"), ("auth_asym_id", "chain_id"), ("auth_atom_id", "atom_name"), ("pdbx_PDB_model_num", "model"),
)


def site_of(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """Atoms in the schema of the PDB reader as atom_site rows; the entity is 1, no alternate location is a point."""
    fixed = {"x": 3, "y": 3, "z": 3, "occupancy": 2, "b_factor": 2}

    def value(item: str, column: str | None) -> Column:
        if column is None:
            return F.lit("1").alias(item)
        if column in fixed:
            return F.when(F.col(column).isNotNull(), F.format_string(f"%.{fixed[column]}f", F.col(column).cast("double"))).alias(item)
        text = F.col(column).cast("string")
        return (F.coalesce(text, F.lit(".")) if column == "alt_loc" else text).alias(item)

    return atoms.select("path", F.col(order).alias("row_idx"), *[value(i, c) for i, c in SITE_ITEMS])


def site_documents(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """(path, content): mmCIF texts with the atoms of PDB files."""
    texts = write_category(site_of(atoms, order), "atom_site", [i for i, _ in SITE_ITEMS])
    return texts.select("path", F.concat(F.lit("data_structure\n"), "content").alias("content"))


def missing_ids(categories: DataFrame) -> DataFrame:
    """(path, row_idx, what): atom_site rows with a chain but without a residue number or name, which no reader can place."""
    item = lambda *names: F.coalesce(*[null_marker(F.try_element_at("attrs", F.lit(n))) for n in names])
    rows = categories.where("category = 'atom_site'").where(item("auth_asym_id", "label_asym_id").isNotNull())
    what = F.when(item("auth_seq_id", "label_seq_id").isNull(), "number").when(item("auth_comp_id", "label_comp_id").isNull(), "name")
    return rows.select("path", "row_idx", what.alias("what")).where("what is not null")
