"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, and a shunting-yard parser
evaluates the and/or/with expressions after the tags."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.arrow import add_columns

#: Words are runs of 0-9, a-z and all characters beyond ASCII, after A-Z are lower-cased.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
LOWER = {c: c + 32 for c in range(65, 91)}
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "the mit license": "mit",
    "gnu free documentation license": "gfdl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "apache license 2 0": "apache-2",
    "apache software license": "apache",
    "licensed under the apache license": "apache",
    "boost software license": "bsl-1.0",
    "artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "sil open font license": "ofl",
    "isc license": "isc",
    "zlib license": "zlib",
    "bsd license": "bsd",
    "bsd zero clause": "0bsd",
    "neither the name of the copyright holder": "bsd-3-clause",
    "the software is provided as is without warranty of any kind": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "python software foundation license": "psf-2.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Identifiers whose terms allow use without obligations on derived works.
PERMISSIVE = {"mit", "mit-0", "apache-2.0", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd", "bsl-1.0", "python-2.0"}
TOKEN = re.compile(r"[ \t]*([()]|[0-9a-z][0-9a-z.+:-]*)")
#: Forms of identifiers (without case) that name a licence, and of exceptions after "with"; other words name none.
IDENTIFIER = re.compile(
    r"mit(?:-0|-cmu|-feh)?|isc|zlib|unlicense|0bsd|x11|ncsa|wtfpl|beerware|postgresql|curl|ruby|vim|libpng|openssl|json|php-3\.0[01]?|python-2\.0|psf-2\.0|bsl-1\.[01]|upl-1\.0|artistic-[12]\.0|apache-(?:1\.[01]|2\.0|2)|bsd-[1-4]-clause(?:-[a-z]+)*|(?:[al]?gpl|gfdl)-[123](?:\.[0-9])?(?:-only|-or-later|\+)?|mpl-[12]\.[01]|epl-[12]\.0|eupl-1\.[012]|cddl-1\.[01]|cecill-(?:[12]\.[01]|[bc])|cc0-1\.0|cc-by(?:-nc)?(?:-sa|-nd)?-[1-4]\.[05]|ofl-1\.[01]|ms-[pr]l|osl-[123]\.[01]|afl-[123]\.[012]|odbl-1\.0|(?:documentref-[0-9a-z.-]+:)?licenseref-[0-9a-z.-]+"
)
EXCEPTION = re.compile(r"[0-9a-z.-]*exception[0-9a-z.-]*|[0-9a-z.-]+-linking[0-9a-z.-]*|linux-syscall-note")
LEAD = re.compile(r"[: \t]*")
RANK = {"with": 3, "and": 2, "or": 1}


def operands(text: str, at: int) -> list[str]:
    """The longest well-formed head of a licence expression in lower-case ``text`` from ``at``, in its line."""
    tokens: list[str] = []
    depth, operand, good = 0, False, 0
    while match := TOKEN.match(text, at):
        token, at = match[1].rstrip(".:-"), match.end()
        if token == "(" and not operand and tokens[-1:] != ["with"]:
            depth += 1
        elif token == ")" and operand and depth:
            depth -= 1
        elif token in RANK and operand and not (token == "with" and (tokens[-1] == ")" or tokens[-2:-1] == ["with"])):
            operand = False
        elif token not in RANK and not operand and (EXCEPTION if tokens[-1:] == ["with"] else IDENTIFIER).fullmatch(token):
            operand = True
        else:
            break
        tokens.append(token)
        if operand and not depth:
            good = len(tokens)
        if token != match[1]:  # a full stop ends the expression
            break
    return tokens[:good]


def evaluate(expression: str | list[str], at: int = 0) -> tuple[list[str], bool] | None:
    """Identifiers of the longest well-formed head of a licence expression, and whether its terms are permissive.

    ``or`` needs one permissive side, ``and`` both; ``with`` keeps what its licence says (its exceptions stand in the
    head, too). None without a head.
    """
    output: list[str] = []
    waiting: list[str] = []
    for token in operands(expression, at) if isinstance(expression, str) else expression:
        if token in RANK:
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                output.append(waiting.pop())
            waiting.append(token)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
        else:
            output.append(token)
    output += reversed(waiting)
    values: list[tuple[list[str], bool]] = []
    for token in output:
        if token not in RANK:
            values.append(([token], token in PERMISSIVE))
            continue
        right, left = values.pop(), values.pop()
        if token == "with":
            values.append(left)
        else:
            values.append((left[0] + right[0], (left[1] and right[1]) if token == "and" else (left[1] or right[1])))
    return values[0] if values else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**NOTICE_PHRASES, **BASE_PHRASES, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> dict:
    """All places of all phrases: (first word, phrase), the evaluated tags, and the number of words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(TABLE).split()
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places, tags, exceptions = [], [], set()
    ends: list[int] = []
    at = word = 0
    for end, phrase in machine.iter(joined):
        start = end - len(phrase) - 1
        word += joined.count(" ", at, start) - joined.count(" ", start, at)
        at = start
        places.append((word, phrase))
        if phrase == TAG:
            if not ends:
                lowered = (text or "").translate(LOWER)
                ends = [m.end() for m in WORD.finditer(lowered)]
            head = operands(lowered, LEAD.match(lowered, ends[word + 2]).end())
            if value := evaluate(head):
                tags.append(value)
                exceptions |= {b for a, b in zip(head, head[1:]) if a == "with"}
    return {"n_words": len(words), "places": places, "tags": tags, "exceptions": sorted(exceptions)}


def summary(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    found = scan(text, machine)
    base = [(w, p) for w, p in found["places"] if p in BASE_PHRASES]
    labels = {BASE_PHRASES[p] for _, p in base}
    more = labels | {NOTICE_PHRASES[p] for _, p in found["places"] if p in NOTICE_PHRASES} | {x for ids, _ in found["tags"] for x in ids}
    score = 1.0 if found["tags"] else 0.9 if base else 0.6 if more else 0.0
    spans = [{"first_word": w, "phrase": p} for w, p in found["places"]]
    permissive = all(ok for _, ok in found["tags"]) if found["tags"] else None
    starts = [w for w, _ in base]
    return found["n_words"], len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score, permissive, ",".join(found["exceptions"]), spans


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, exceptions string, places array<struct<first_word:long,phrase:string>>"


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the places, labels and score of each whole text; one output row per input row.

    A null or empty text has no words, no places, empty labels and score 0. ``permissive`` is null without a tag.
    Overlapping places all count. Input columns of the new names are replaced. An empty table gives an empty table.
    """
    at = docs.columns.index(text_col)

    def compute(column: int):
        machine = automaton()

        def run(batch: pa.RecordBatch) -> list:
            rows = [summary(t, machine) for t in batch.column(column).to_pylist()]
            return [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(10)]

        return run

    return add_columns(docs, FIELDS, compute, at)
