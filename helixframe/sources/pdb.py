"""Fixed-width PDB lines: scan, parse and format with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of an atom line: name, first column (from 1), width, type.
LAYOUT = (
    ("record_type", 1, 6, "string"),
    ("serial", 7, 5, "int"),
    ("atom_name", 13, 4, "string"),
    ("alt_loc", 17, 1, "string"),
    ("residue_name", 18, 3, "string"),
    ("chain_id", 22, 1, "string"),
    ("residue_number", 23, 4, "int"),
    ("insertion_code", 27, 1, "string"),
    ("x", 31, 8, "double"),
    ("y", 39, 8, "double"),
    ("z", 47, 8, "double"),
    ("occupancy", 55, 6, "double"),
    ("b_factor", 61, 6, "double"),
    ("element", 77, 2, "string"),
    ("charge", 79, 2, "string"),
)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_number, value) of text files, gzipped or not; line numbers count within a file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("line_number", "value"))


def wide_number(value: Column, width: int) -> Column:
    """A whole number in ``width`` characters: decimal where it fits, else in base 36 with a letter first (upper, then
    lower case), as serials beyond 99999 are commonly written; null beyond that."""
    n, least, block = value.cast("long"), 10**width, 26 * 36 ** (width - 1)
    first = n - least + 10 * 36 ** (width - 1)
    in_letters = F.when(n < least + block, F.upper(F.conv(first.cast("string"), 10, 36))).when(n < least + 2 * block, F.lower(F.conv((first - block).cast("string"), 10, 36)))
    plain = F.length(n.cast("string")) <= width
    return F.when(plain, F.lpad(n.cast("string"), width, " ")).when(n > 0, in_letters)


def read_wide_number(text: Column, width: int) -> Column:
    """The inverse of :func:`wide_number`, for trimmed text; null where it is no number."""
    least, block = 10**width, 26 * 36 ** (width - 1)
    from_letters = F.conv(text, 36, 10).cast("long") - 10 * 36 ** (width - 1) + least
    whole = F.length(text) == width
    return F.when(whole & text.rlike("^[A-Z][0-9A-Z]*$"), from_letters).when(whole & text.rlike("^[a-z][0-9a-z]*$"), from_letters + block).otherwise(text.try_cast("long"))


def field(value: Column, start: int, width: int, kind: str) -> Column:
    text = F.trim(F.substring(value, start, width))
    text = F.when(text != "", text)
    return text if kind == "string" else read_wide_number(text, width).cast("int") if kind == "int" else text.try_cast(kind)


def parse_atom_lines(lines: DataFrame) -> DataFrame:
    """Atoms of (path, line_number, value), blank fields null, unreadable numbers null; further columns stay."""
    atoms = lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM"))
    more = [c for c in lines.columns if c not in ("path", "line_number", "value")]
    return atoms.select("path", "line_number", *[field(F.col("value"), a, w, k).alias(n) for n, a, w, k in LAYOUT], *more)


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms with their model number (1 before any MODEL line; a malformed MODEL line keeps the number before it)."""
    lines = scan_lines(spark, path)
    number = F.when(F.col("value").startswith("MODEL"), F.trim(F.substring("value", 7, 20)).try_cast("int"))
    window = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    models = lines.withColumn("model", F.coalesce(F.last(number, ignorenulls=True).over(window), F.lit(1)))
    return parse_atom_lines(models)


def read_modres(spark: SparkSession, path: str) -> DataFrame:
    """MODRES records: residue, chain, number, insertion code, standard residue."""
    v = F.col("value")
    rows = scan_lines(spark, path).where(v.startswith("MODRES"))
    parts = (("residue_name", 13, 3, "string"), ("chain_id", 17, 1, "string"), ("residue_number", 19, 4, "int"), ("insertion_code", 23, 1, "string"), ("standard_name", 25, 3, "string"))
    return rows.select("path", *[field(v, a, w, k).alias(n) for n, a, w, k in parts])


def atom_line(*, record: Column, serial: Column, name: Column, alt: Column, residue: Column, chain: Column, number: Column, icode: Column, x: Column, y: Column, z: Column, occupancy: Column, b: Column, element: Column, charge: Column) -> Column:
    """An 80-column atom line. Names of up to three letters get a leading blank; a charge 2 is written 2+.

    Serials and residue numbers that are too long are written by :func:`wide_number`. Where any other value is wider than
    its field, or a coordinate is null, the line is null: nothing is cut.
    """

    def text(c: Column, width: int, left: bool = False) -> Column:
        c = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(F.length(c) <= width, F.rpad(c, width, " ") if left else F.lpad(c, width, " "))

    def real(c: Column, width: int, digits: int) -> Column:
        return text(F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double"))).otherwise(F.lit("?" * 99)), width)

    def whole(c: Column, width: int) -> Column:
        return F.when(c.isNull(), F.lit(" " * width)).otherwise(wide_number(c, width))

    named = F.when(F.length(name) < 4, F.concat(F.lit(" "), name)).otherwise(name)
    signed = F.when(charge.rlike("^[0-9]$"), F.concat(charge, F.lit("+"))).otherwise(charge)
    return F.concat(
        text(record, 6, True), whole(serial, 5), F.lit(" "), text(named, 4, True), text(alt, 1), text(residue, 3), F.lit(" "), text(chain, 1), whole(number, 4), text(icode, 1), F.lit("   "),
        real(x, 8, 3), real(y, 8, 3), real(z, 8, 3), real(occupancy, 6, 2), real(b, 6, 2), F.lit(" " * 10), text(element, 2), text(signed, 2),
    )
