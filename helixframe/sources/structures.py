"""Structure files of any format, filters that keep the rest of a file, and files per model or category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.groups import keep_first, most_common
from helixframe.operators.structure import pdb_documents
from helixframe.sources import cif, pdb

EXTENSIONS = {"pdb": r"\.pdb(\.gz)?$", "mmcif": r"\.(cif|mmcif)(\.gz)?$"}
COLUMNS = ("path", "line_number", "record_type", "serial", "atom_name", "alt_loc", "residue_name", "chain_id", "residue_number", "insertion_code", "x", "y", "z", "occupancy", "b_factor", "element", "charge", "model")


def format_of(content: Column) -> Column:
    """mmcif for a text with a line that begins with _atom_site, else pdb."""
    return F.when(content.rlike(r"(?m)^_atom_site"), "mmcif").otherwise("pdb")


def normalised_cif(content: Column) -> Column:
    """mmCIF text whose empty data_ header has a name, and whose coordinate items are written Cartn_x."""
    named = F.regexp_replace(content, r"(?m)^data_\s*$", "data_structure\n")
    return F.regexp_replace(named, r"(?mi)^_atom_site\.cartn_([xyz])", "_atom_site.Cartn_$1")


def check_extensions(paths: list[str]) -> None:
    """Raise ValueError for files that are neither .pdb nor .cif or .mmcif (each also with .gz)."""
    import re

    bad = [p for p in paths if not any(re.search(e, p.lower()) for e in EXTENSIONS.values())]
    if bad:
        raise ValueError(f"not a structure file: {', '.join(bad)}")


def read_structures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Atoms of PDB and mmCIF files, by their extensions, in one schema; line_number orders the atoms of a file."""
    import re

    check_extensions(paths)
    parts = []
    for kind, pattern in EXTENSIONS.items():
        mine = [p for p in paths if re.search(pattern, p.lower())]
        if mine and kind == "pdb":
            parts.append(pdb.read_pdb(spark, mine).select(*COLUMNS))
        elif mine:
            parts.append(cif.read_atoms(spark, mine).withColumnRenamed("row_idx", "line_number").select(*COLUMNS))
    if not parts:
        raise ValueError("no structure files")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def filter_lines(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines of PDB files without the atoms that ``kept`` (path, line_number) does not name; all other lines stay."""
    atom = F.substring("value", 1, 6).isin("ATOM  ", "HETATM")
    chosen = lines.where(atom).join(kept.select("path", "line_number").distinct(), ["path", "line_number"], "left_semi")
    return lines.where(~atom).select("path", "line_number", "value").unionByName(chosen.select("path", "line_number", "value"))


def filter_site(categories: DataFrame, kept: DataFrame) -> DataFrame:
    """Category rows without the atom_site rows that ``kept`` (path, row_idx) does not name; other categories stay."""
    site = F.col("category") == "atom_site"
    chosen = categories.where(site).join(kept.select("path", "row_idx").distinct(), ["path", "row_idx"], "left_semi")
    return categories.where(~site).unionByName(chosen.select(*categories.columns))


def line_documents(lines: DataFrame) -> DataFrame:
    """(path, content) of (path, line_number, value), lines in order."""
    grouped = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_number", "value"))).alias("l"))
    return grouped.select("path", F.array_join("l.value", "\n").alias("content"))


def cif_documents(categories: DataFrame) -> DataFrame:
    """(path, content): mmCIF texts of category rows: one loop for each category, by name, atom_site last."""
    items = categories.groupBy("path", "block", "category").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attrs"))))).alias("items"))
    rows = categories.join(items, ["path", "block", "category"])
    line = F.array_join(F.transform("items", lambda i: cif.quote(F.try_element_at("attrs", i))), " ")
    loops = rows.groupBy("path", "block", "category", "items").agg(F.sort_array(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("rows"))
    head = F.array_join(F.transform("items", lambda i: F.concat(F.lit("_"), F.col("category"), F.lit("."), i)), "\n")
    text = F.concat(F.lit("loop_\n"), head, F.lit("\n"), F.array_join("rows.line", "\n"), F.lit("\n#\n"))
    blocks = loops.groupBy("path", "block").agg(F.sort_array(F.collect_list(F.struct((F.col("category") == "atom_site").alias("last"), "category", text.alias("text")))).alias("t"))
    whole = blocks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", F.array_join("t.text", "").alias("text")))).alias("b"))
    return whole.select("path", F.array_join(F.transform("b", lambda b: F.concat(F.lit("data_"), b["block"], F.lit("\n"), b["text"])), "").alias("content"))


def model_documents(atoms: DataFrame, order: str = "line_number") -> DataFrame:
    """(path, model, content): a PDB text for each model of each file."""
    parts = atoms.withColumn("path", F.to_json(F.struct("path", "model")))
    key = F.from_json("path", "path string, model int")
    return pdb_documents(parts, order).select(key.alias("k"), "content").select("k.path", "k.model", "content")


def category_rows(categories: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named categories (always with ``struct``) as (path, category, row_idx, item, value), for CSV."""
    rows = categories.where(F.col("category").isin("struct", *names))
    return rows.select("path", "category", "row_idx", F.explode("attrs").alias("item", "value")).withColumn("value", F.when(~F.col("value").isin("?", "."), F.col("value")))


def write_categories(categories: DataFrame, names: list[str], folder: str) -> None:
    """A CSV folder for each of the categories, with the items that any file has as columns."""
    rows = category_rows(categories, names)
    for name in ("struct", *[n for n in names if n != "struct"]):
        rows.where(F.col("category") == name).groupBy("path", "row_idx").pivot("item").agg(F.first("value")).drop("row_idx").write.csv(f"{folder}/{name}", header=True)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(component, atom_id, alt_atom_id, place) of CSV files of reference components named component_<name>.csv."""
    rows = spark.read.csv(path, header=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"component_([^/.]+)\.csv$", 1).alias("component"), "atom_id", "alt_atom_id", F.monotonically_increasing_id().alias("place"))
    return rows.where("component <> ''")


def unify(atoms: DataFrame, components: DataFrame) -> DataFrame:
    """Atoms of structures that have the same residues, with standard names in the components' order and common ids.

    ``atoms``: id, residue (a number in order), residue_name, chain_id, residue_number, insertion_code, atom_name. Residues
    without a component, hydrogens and unknown atoms go, as do residues whose number of atoms differs between structures.
    Where structures name a residue differently, the most frequent identifier counts, the first structure's among equals.
    Raises ValueError where structures have other numbers or names of residues. ``place`` orders the atoms of a residue.
    """
    from pyspark.sql import Window

    names = components.where(~F.col("atom_id").startswith("H"))
    both = names.select("component", F.col("atom_id").alias("given"), "atom_id", "place").unionByName(names.where("alt_atom_id <> atom_id").select("component", F.col("alt_atom_id").alias("given"), "atom_id", "place"))
    both = keep_first(both, ["component", "given"], [F.asc("place")])
    known = atoms.join(both, (F.col("residue_name") == F.col("component")) & (F.col("atom_name") == F.col("given"))).drop("component", "given", "atom_name").withColumnRenamed("atom_id", "atom_name")
    listed = atoms.join(components.select(F.col("component").alias("residue_name")).distinct(), "residue_name", "left_semi").select("id", "residue", "residue_name", "chain_id", "residue_number", "insertion_code").distinct()
    listed = listed.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("residue")))
    n = listed.select("id").distinct().count()
    per_place = listed.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("residue_name").alias("names"))
    if not per_place.where((F.col("n") != n) | (F.col("names") > 1)).isEmpty():
        raise ValueError("structures have other residues")
    counted = known.groupBy("id", "residue").agg(F.count("*").alias("n"))
    sizes = listed.join(counted, ["id", "residue"], "left").groupBy("k").agg(F.count_distinct(F.coalesce("n", F.lit(0))).alias("sizes"))
    kept = listed.join(sizes.where("sizes = 1").select("k"), "k", "left_semi")
    identity = F.struct("chain_id", "residue_number", "insertion_code")
    votes = most_common(kept.select("k", identity.alias("who"), "id"), ["k"], "who", "id")
    named = kept.select("id", "residue", "k").join(votes.select("k", "who"), "k")
    out = known.drop("chain_id", "residue_number", "insertion_code").join(named, ["id", "residue"])
    return out.select("*", "who.*").drop("who", "k")
