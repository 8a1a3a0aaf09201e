"""Residue and atom names, classes and thresholds as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and atoms that decide the class of a molecule.
RNA_NAMES = ("A", "C", "G", "U", "I")
DNA_NAMES = ("DA", "DC", "DG", "DT", "DU", "DI")
DEOXY_SUGAR = ("C1'", "C2'", "C3'", "C4'", "O4'")
# Atom radii in angstrom by the first letter of the name.
RADII = {"C": 0.6, "N": 0.54, "O": 0.53, "P": 0.94}
# Names of water and amino-acid residues.
WATER_NAMES = ("HOH", "WAT", "H2O", "DOD")
AMINO_ACIDS = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "SEC", "PYL", "MSE", "UNK")


def full_name(chain: Column, name: Column, number: Column, icode: Column) -> Column:
    """Readable id: chain, name, a slash if the name ends in a digit, number, insertion code after a caret."""
    slash = F.when(name.rlike("[0-9]$"), F.lit("/")).otherwise(F.lit(""))
    code = F.when(icode.isNotNull() & (F.trim(icode) != ""), F.concat(F.lit("^"), icode)).otherwise(F.lit(""))
    return F.concat(chain, F.lit("."), name, slash, number.cast("string"), code)


def molecule_class(name: Column, atoms: Column) -> Column:
    """RNA, DNA or Other from the residue name in any case, else from the names of its atoms."""
    name = F.upper(name)
    sugar = F.size(F.array_intersect(atoms, F.array(*map(F.lit, DEOXY_SUGAR))))
    return (
        F.when(name.isin(*RNA_NAMES), "RNA")
        .when(name.isin(*DNA_NAMES), "DNA")
        .when(F.array_contains(atoms, "O2'"), "RNA")
        .when(sugar >= 4, "DNA")
        .otherwise("Other")
    )


def atom_radius(name: Column) -> Column:
    radii = F.create_map(*[F.lit(x) for kv in RADII.items() for x in kv])
    return F.try_element_at(radii, F.substring(name, 1, 1))


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    """All columns lie within their inclusive ranges."""
    return reduce(lambda a, b: a & b, [F.col(c).between(low, high) for c, (low, high) in ranges.items()])


def default_altloc(alt: Column) -> Column:
    """Unlabelled alternate locations and A."""
    return altloc(alt)


def altloc(alt: Column, wanted: str = "A") -> Column:
    """Unlabelled alternate locations and the wanted one; all of them for "all"."""
    return F.lit(True) if wanted == "all" else alt.isNull() | alt.isin("", ".", "?", wanted)


def null_marker(value: Column) -> Column:
    """mmCIF's ? and . as null."""
    return F.when(~value.isin("?", "."), value)
