"""Filters and column changes on mmCIF categories (path, category, row_idx, attrs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.groups import by_first_seen

#: Where an entity or a chain is named in other categories: category, item.
ENTITY_ITEMS = (("entity", "id"), ("entity_poly", "entity_id"), ("entity_poly_seq", "entity_id"), ("struct_asym", "entity_id"), ("atom_site", "label_entity_id"))
CHAIN_ITEMS = (("struct_asym", "id"), ("atom_site", "label_asym_id"), ("pdbx_poly_seq_scheme", "asym_id"), ("pdbx_nonpoly_scheme", "asym_id"), ("pdbx_struct_mod_residue", "label_asym_id"))


def item(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def select_ids(categories: DataFrame, category: str, field: str, values: list[str], id_field: str) -> DataFrame:
    """(path, id): ids of the rows of a category whose field has one of the values."""
    rows = categories.where((F.col("category") == category) & item(field).isin(*values))
    return rows.select("path", item(id_field).alias("id")).distinct()


def keep_ids(categories: DataFrame, ids: DataFrame, places: tuple[tuple[str, str], ...]) -> DataFrame:
    """Categories whose named items hold one of the file's ids; categories without such an item stay whole."""
    key = F.coalesce(*[F.when(F.col("category") == c, item(i)) for c, i in places])
    bound = F.col("category").isin(*[c for c, _ in places])
    marked = categories.withColumn("_key", key)
    kept = marked.where(bound).join(ids.select("path", F.col("id").alias("_key")), ["path", "_key"], "left_semi")
    return kept.select(*categories.columns).unionByName(categories.where(~bound))


def filter_by_entities(categories: DataFrame, entities: list[str]) -> DataFrame:
    """Rows that belong to the entities, and to their chains."""
    files = categories.select("path").distinct()
    ids = files.withColumn("id", F.explode(F.array(*map(F.lit, entities))))
    chains = select_ids(categories, "struct_asym", "entity_id", entities, "id")
    kept = keep_ids(categories, ids, ENTITY_ITEMS)
    return keep_ids(kept, chains, tuple(p for p in CHAIN_ITEMS if p[0] not in {c for c, _ in ENTITY_ITEMS}))


def filter_by_polymer_types(categories: DataFrame, types: list[str]) -> DataFrame:
    """Rows that belong to polymers of the types."""
    ids = select_ids(categories, "entity_poly", "type", types, "entity_id")
    chains = categories.where("category = 'struct_asym'").select("path", item("entity_id").alias("id"), item("id").alias("chain")).join(ids, ["path", "id"], "left_semi")
    kept = keep_ids(categories, ids, ENTITY_ITEMS)
    return keep_ids(kept, chains.select("path", F.col("chain").alias("id")), tuple(p for p in CHAIN_ITEMS if p[0] not in {c for c, _ in ENTITY_ITEMS}))


def filter_by_chains(categories: DataFrame, chains: list[str], author: bool = True) -> DataFrame:
    """atom_site rows of the chains, and the entities and chains that these rows name."""
    field = "auth_asym_id" if author else "label_asym_id"
    site = F.col("category") == "atom_site"
    atoms = categories.where(site & item(field).isin(*chains))
    rest = categories.where(~site)
    own = tuple(p for p in ENTITY_ITEMS if p[0] != "atom_site" and p[0] != "struct_asym")
    kept = keep_ids(rest, atoms.select("path", item("label_entity_id").alias("id")).distinct(), own)
    kept = keep_ids(kept, atoms.select("path", item("label_asym_id").alias("id")).distinct(), tuple(p for p in CHAIN_ITEMS if p[0] != "atom_site"))
    return atoms.unionByName(kept)


def closure(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], kept: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without rows that name a parent row which is not kept.

    links: (child, item, parent, item) of a table that names another one, parents before their children, as a dictionary
    of linked items gives them. kept: the tables that the filter starts from. A null item names nothing and goes.
    """
    out = dict(kept)
    for child, item_, parent, key in links:
        if parent in out:
            ids = out[parent].select(F.col(key).alias("_key")).distinct()
            rows = out.get(child, tables[child])
            out[child] = rows.join(ids, F.col(item_) == F.col("_key"), "left_semi")
    return {**tables, **out}


def _put(name: str, value: Column) -> Column:
    others = F.map_filter("attrs", lambda k, v: k != name)
    return F.map_concat(others, F.map_from_arrays(F.array(F.lit(name)), F.array(value)))


def copy_item(categories: DataFrame, category: str, source: str, target: str) -> DataFrame:
    """The category's ``target`` item takes the values of ``source``; it is added where it is missing."""
    here = (F.col("category") == category) & item(source).isNotNull()
    return categories.withColumn("attrs", F.when(here, _put(target, item(source))).otherwise(F.col("attrs")))


def replace_item(categories: DataFrame, category: str, name: str, codes: str) -> tuple[DataFrame, DataFrame]:
    """The item's values replaced by single codes in order of first appearance per file; also (path, value, code).

    Raises IndexError where a file has more values than there are codes.
    """
    rows = categories.where((F.col("category") == category) & item(name).isNotNull()).select("path", "row_idx", item(name).alias("value"))
    numbered = by_first_seen(rows, "value", "row_idx", ["path"], "n")
    most = numbered.agg(F.max("n")).first()[0] or 0
    if most > len(codes):
        raise IndexError(f"{most} values but {len(codes)} codes")
    mapping = numbered.select("path", "value", F.substring(F.lit(codes), F.col("n"), F.lit(1)).alias("code"))
    joined = categories.withColumn("value", F.when(F.col("category") == category, item(name))).join(mapping, ["path", "value"], "left")
    return joined.withColumn("attrs", F.when(F.col("code").isNotNull(), _put(name, F.col("code"))).otherwise(F.col("attrs"))).select(*categories.columns), mapping
