"""Names, letters and classes of residues and base pairs as Column expressions.

``atoms`` stands for a map from atom names to points, ``names`` for an array of atom names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import geometry

# Atoms of backbone and bases that templates of nucleotides are made of.
RIBOSE_BACKBONE = ("P", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "O2'", "C1'")
DEOXY_BACKBONE = ("P", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "C1'")
PURINE_CORE = ("N9", "C8", "N7", "C5", "C6", "N1", "C2", "N3", "C4")
PYRIMIDINE_CORE = ("N1", "C2", "N3", "C4", "C5", "C6")
TEMPLATES = {
    "A": (*RIBOSE_BACKBONE, *PURINE_CORE, "N6"),
    "G": (*RIBOSE_BACKBONE, *PURINE_CORE, "O6"),
    "C": (*RIBOSE_BACKBONE, *PYRIMIDINE_CORE, "N4", "O2"),
    "U": (*RIBOSE_BACKBONE, *PYRIMIDINE_CORE, "O4", "O2"),
    "DA": (*DEOXY_BACKBONE, *PURINE_CORE, "N6"),
    "DG": (*DEOXY_BACKBONE, *PURINE_CORE, "O6"),
    "DC": (*DEOXY_BACKBONE, *PYRIMIDINE_CORE, "N4", "O2"),
    "DT": (*DEOXY_BACKBONE, *PYRIMIDINE_CORE, "O4", "O2", "C7"),
}
REQUIRED = ("C1'", "C2'", "C3'", "C4'", "O4'", "N1", "C2", "N3", "C4", "C5", "C6")
PHOSPHATE_ATOMS = ("P", "OP1", "OP2", "O3'", "O5'")
SUGAR_ATOMS = ("C1'", "C2'", "C3'", "C4'", "C5'", "O4'")
HEAVY = {
    "A": ("N1", "C2", "N3", "C4", "C5", "C6", "N6", "N7", "C8", "N9"),
    "G": ("N1", "C2", "N2", "N3", "C4", "C5", "C6", "O6", "N7", "C8", "N9"),
    "C": ("N1", "C2", "O2", "N3", "C4", "N4", "C5", "C6"),
    "U": ("N1", "C2", "O2", "N3", "C4", "O4", "C5", "C6"),
    "T": ("N1", "C2", "O2", "N3", "C4", "O4", "C5", "C5M", "C6"),
}
OUTERMOST = {"A": "N9", "G": "N9", "C": "N1", "U": "N1", "T": "N1"}
INNERMOST = {"A": "N6", "G": "O6", "C": "N4", "U": "O4", "T": "O4"}
# Saenger's class of two bases and their Leontis-Westhof class; XIII, XIV and XV are impossible.
SAENGER = {
    "AA tWW": "I", "AA tHH": "II", "GG tWW": "III", "GG tSS": "IV", "AA tWH": "V", "AA tHW": "V", "GG cWH": "VI", "GG cHW": "VI",
    "GG tWH": "VII", "GG tHW": "VII", "AG cWW": "VIII", "GA cWW": "VIII", "AG cHW": "IX", "GA cWH": "IX", "AG tWS": "X", "GA tSW": "X",
    "AG tHS": "XI", "GA tSH": "XI", "UU tWW": "XII", "TT tWW": "XII", "UU cWW": "XVI", "TT cWW": "XVI", "CU tWW": "XVII", "UC tWW": "XVII",
    "CU cWW": "XVIII", "UC cWW": "XVIII", "CG cWW": "XIX", "GC cWW": "XIX", "AU cWW": "XX", "UA cWW": "XX", "AT cWW": "XX", "TA cWW": "XX",
    "AU tWW": "XXI", "UA tWW": "XXI", "AT tWW": "XXI", "TA tWW": "XXI", "CG tWW": "XXII", "GC tWW": "XXII", "AU cHW": "XXIII", "UA cWH": "XXIII",
    "AT cHW": "XXIII", "TA cWH": "XXIII", "AU tHW": "XXIV", "UA tWH": "XXIV", "AT tHW": "XXIV", "TA tWH": "XXIV", "AC tHW": "XXV", "CA tWH": "XXV",
    "AC tWW": "XXVI", "CA tWW": "XXVI", "GU tWW": "XXVII", "UG tWW": "XXVII", "GT tWW": "XXVII", "TG tWW": "XXVII",
    "GU cWW": "XXVIII", "UG cWW": "XXVIII", "GT cWW": "XXVIII", "TG cWW": "XXVIII",
}
CANONICAL = ("XIX", "XX", "XXVIII")
CANONICAL_BASES = ("AU", "AT", "CG", "GU")
#: Leontis-Westhof classes in the order of their scores, from 1.
SCORED = ("cWW", "tWW", "cWH", "tWH", "cWS", "tWS", "cHW", "tHW", "cHH", "tHH", "cHS", "tHS", "cSW", "tSW", "cSH", "tSH", "cSS", "tSS")
# Class of a base's contact with a phosphate or ribose by letter and donor; some depend on a torsion.
BACKBONE_CLASS = {"A C2": 2, "A C8": 0, "G N1": 5, "G C8": 0, "C C5": 9, "C C6": 0, "U N3": 5, "U C5": 9, "U C6": 0, "T N3": 5, "T C6": 0, "T C7": 9}
#: By letter and donor: two atoms before the donor, the class for a torsion within 90 degrees, and for others.
BACKBONE_TURNED = {"A N6": ("N1", "C6", 6, 7), "G N2": ("N3", "C2", 1, 3), "C N4": ("N3", "C4", 6, 7)}


def table(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(key: Column, values: dict[str, object]) -> Column:
    """The value of a key in a small table, null where it has none."""
    return F.try_element_at(table(values), key)


def _set(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def preferred(author: Column, label: Column, name: str) -> Column:
    """A field of the author's residue id where there is one at all, else of the label's; a blank insertion code is null."""
    value = F.when(author.isNotNull(), author[name]).otherwise(label[name])
    return F.when(F.trim(value) != "", value) if name == "icode" else value


def one_letter(name: Column, sequence: Column | None = None, place: Column | None = None) -> Column:
    """The letter of a residue: that of its entity's sequence at its place (from 1), a one-letter name, the letter after
    D, else the name's last letter, else n."""
    own = F.when(F.length(name) == 1, name).when(name.rlike("^[Dd].$"), F.substring(name, 2, 1)).when(name.rlike("[A-Za-z]$"), F.substring(name, -1, 1)).otherwise(F.lit("n"))
    if sequence is None or place is None:
        return own
    listed = F.when((place >= 1) & (place <= F.length(sequence)), F.substring(sequence, place.cast("int"), F.lit(1)))
    return F.coalesce(listed, own)


def _best(scores: dict[str, Column], least: Column) -> Column:
    """The first key with the highest score above ``least``, null if there is none."""
    most = F.greatest(*scores.values())
    found = reduce(lambda out, kv: F.when(kv[1] == most, F.lit(kv[0])).otherwise(out), reversed(list(scores.items())), F.lit(None).cast("string"))
    return F.when(most > least, found)


def letter_by_overlap(names: Column) -> Column:
    """The base with the largest part of its heavy atoms among ``names``, the first of A, C, G, U, T at a tie; ? for none."""
    from helixframe.operators.annotate import BASE_ATOMS

    parts = {k: F.size(F.array_intersect(names, _set(BASE_ATOMS[k]))) / len(BASE_ATOMS[k]) for k in "ACGUT"}
    return F.coalesce(_best(parts, F.lit(0.0)), F.lit("?"))


def letter_by_template(name: Column, names: Column) -> Column:
    """The template that most atoms match, lower case for DNA; the name's first letter if the residue is no nucleotide."""
    found = _best({k: F.size(F.array_intersect(names, _set(v))) for k, v in TEMPLATES.items()}, F.lit(-1))
    letter = F.when(F.length(found) == 1, found).otherwise(F.lower(F.substring(found, 2, 1)))
    first = F.when(F.length(name) > 0, F.substring(name, 1, 1)).otherwise(F.lit("?"))
    return F.when(has_required_atoms(names), letter).otherwise(F.coalesce(first, F.lit("?")))


def has_required_atoms(names: Column) -> Column:
    """All atoms that make a nucleotide are there."""
    return F.size(F.array_except(_set(REQUIRED), names)) == 0


def nucleotide_score(atoms: Column) -> Column:
    """Mean of four parts between 0 and 1: phosphate atoms, sugar atoms, the best base, and bonds of at most 2 angstrom."""
    names = F.map_keys(atoms)
    part = lambda wanted: F.size(F.array_intersect(names, _set(wanted))) / len(wanted)
    at = lambda n: F.try_element_at(atoms, F.lit(n))
    bonded = lambda a, b: F.coalesce(geometry.distance(at(a), at(b)) <= 2.0, F.lit(False))
    bonds = F.when(bonded("P", "O5'"), 0.5).otherwise(0.0) + F.when(bonded("C1'", "N9") | bonded("C1'", "N1"), 0.5).otherwise(0.0)
    return (part(PHOSPHATE_ATOMS) + part(SUGAR_ATOMS) + F.greatest(*[part(v) for v in HEAVY.values()]) + bonds) / 4


def is_nucleotide(atoms: Column) -> Column:
    return nucleotide_score(atoms) > 0.5


def has_base_atoms(letter: Column, names: Column) -> Column:
    """All heavy atoms of the base are there; false for other letters than A, C, G, U."""
    whole = reduce(lambda out, k: F.when(letter == k, F.size(F.array_except(_set(HEAVY[k]), names)) == 0).otherwise(out), "ACGU", F.lit(False))
    return F.coalesce(whole, F.lit(False))


def outermost_atom(letter: Column, atoms: Column) -> Column:
    """Name of the atom at the sugar: the base's own, else N9, N1, C1', else any."""
    return _first_held(F.upper(letter), OUTERMOST, ("N9", "N1", "C1'"), atoms)


def innermost_atom(letter: Column, atoms: Column) -> Column:
    """Name of the atom farthest from the sugar: the base's own, else one at place 6 or 4, else any."""
    return _first_held(F.upper(letter), INNERMOST, ("C6", "C4", "O6", "N6", "S6", "O4", "N4", "S4"), atoms)


def _first_held(letter: Column, own: dict[str, str], others: tuple[str, ...], atoms: Column) -> Column:
    held = lambda n: F.when(F.map_contains_key(atoms, n), n)
    return F.coalesce(held(lookup(letter, own)), *[held(F.lit(n)) for n in others], F.get(F.map_keys(atoms), F.lit(0)))


def saenger(one: Column, two: Column, lw: Column) -> Column:
    """Saenger's class of two bases (upper case) with a Leontis-Westhof class, null where there is none."""
    return lookup(F.concat(one, two, F.lit(" "), lw), SAENGER)


def reverse_lw(lw: Column) -> Column:
    """The class with the edges exchanged."""
    return F.concat(F.substring(lw, 1, 1), F.substring(lw, 3, 1), F.substring(lw, 2, 1))


def reverse_topology(topology: Column) -> Column:
    return F.when(topology == "upward", "downward").when(topology == "downward", "upward").otherwise(topology)


def pair_score(lw: Column) -> Column:
    """1 to 18 in the order of classes, 20 for none."""
    place = F.array_position(_set(SCORED), lw)
    return F.when(place > 0, place).otherwise(F.lit(20)).cast("int")


def is_canonical(one: Column, two: Column, lw: Column, saenger_class: Column) -> Column:
    """By the Saenger class where there is one, else cis Watson-Crick pairs of AU, AT, CG and GU."""
    one, two = F.upper(one), F.upper(two)
    bases = F.concat(F.least(one, two), F.greatest(one, two))
    return F.when(saenger_class.isNotNull(), saenger_class.isin(*CANONICAL)).otherwise(F.coalesce((lw == "cWW") & bases.isin(*CANONICAL_BASES), F.lit(False)))


def backbone_class(letter: Column, donor: Column, atoms: Column, donor_point: Column, acceptor_point: Column) -> Column:
    """Class 0 to 9 of a base's contact with a phosphate or ribose oxygen, null for none. atoms: of the donor's residue."""
    key = F.concat(letter, F.lit(" "), donor)
    ends = [F.try_element_at(atoms, lookup(key, {k: v[i] for k, v in BACKBONE_TURNED.items()})) for i in (0, 1)]
    # One element of an array is a variable of the function over it, so its parts are not written out again and again.
    points = F.array(F.struct(ends[0].alias("p"), ends[1].alias("q"), donor_point.alias("r"), acceptor_point.alias("s")))
    turn = F.get(F.transform(points, lambda x: F.when(x["p"].isNotNull() & x["q"].isNotNull(), F.degrees(geometry.torsion(x["p"], x["q"], x["r"], x["s"])))), F.lit(0))
    near, far = (lookup(key, {k: v[i] for k, v in BACKBONE_TURNED.items()}) for i in (2, 3))
    turned = F.when((turn > -90) & (turn < 90), near).when(turn.isNotNull(), far)
    return F.coalesce(lookup(key, BACKBONE_CLASS), turned).cast("int")
