"""Chat formatting with built-in functions only.

Records of any layout become a variant. The nested field paths that a record holds are hashed; the hash selects a
declarative mapping from its layout to canonical turns (role, text). A template then writes the turns as one string:

    <s>[INST] role [/INST] text</s>

Control strings inside roles and texts are broken up by a backslash after their first character, and backslashes are
doubled, so that the string can be read back exactly. The loss mask covers the texts of the assistant.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.arrow import free_names

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"


@dataclass(frozen=True)
class Layout:
    """rules: ("each", array, role field, text field) or ("one", role, field). roles: renamed roles."""

    name: str
    rules: tuple[tuple[str, ...], ...]
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> list[str]:
        return sorted(p for r in self.rules for p in ([f"{r[1]}[].{r[2]}", f"{r[1]}[].{r[3]}"] if r[0] == "each" else [r[2]]))


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("messages", (("each", "messages", "role", "content"),)),
    Layout("messages_text", (("each", "messages", "role", "text"),)),
    Layout("turns", (("each", "turns", "role", "text"),)),
    Layout("conversations", (("each", "conversations", "from", "value"),), SHARED_ROLES),
    Layout("conversations_role", (("each", "conversations", "role", "content"),), SHARED_ROLES),
    Layout("instruction", (("one", "user", "instruction"), ("one", "assistant", "output"))),
    Layout("instruction_input", (("one", "user", "instruction"), ("one", "user", "input"), ("one", "assistant", "output"))),
    Layout("instruction_system", (("one", "system", "system"), ("one", "user", "instruction"), ("one", "assistant", "output"))),
    Layout("instruction_response", (("one", "user", "instruction"), ("one", "assistant", "response"))),
    Layout("prompt_completion", (("one", "user", "prompt"), ("one", "assistant", "completion"))),
    Layout("prompt_response", (("one", "user", "prompt"), ("one", "assistant", "response"))),
    Layout("prompt_system", (("one", "system", "system"), ("one", "user", "prompt"), ("one", "assistant", "response"))),
    Layout("question_answer", (("one", "user", "question"), ("one", "assistant", "answer"))),
)


def path_hash(paths: list[str]) -> str:
    return hashlib.md5("|".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """md5 of the sorted field paths that the layouts speak of and the record holds; other fields do not matter."""

    def held(path: str) -> Column:
        if "[]." not in path:
            return F.try_variant_get(record, f"$.{path}", "string").isNotNull()
        array, field = path.split("[].")
        return F.exists(F.try_variant_get(record, f"$.{array}", "array<variant>"), lambda e: F.try_variant_get(e, f"$.{field}", "string").isNotNull())

    paths = sorted({p for x in layouts for p in x.paths})
    return F.md5(F.concat_ws("|", *[F.when(held(p), F.lit(p)) for p in paths]))


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _turn_of(who: str, what: str, role):
    return lambda e: F.struct(role(F.try_variant_get(e, f"$.{who}", "string")).alias("role"), _blank(F.try_variant_get(e, f"$.{what}", "string")).alias("text"))


def _turns(record: Column, layout: Layout) -> Column:
    def role(x: Column) -> Column:
        for old, new in layout.roles:
            x = F.when(x == old, F.lit(new)).otherwise(x)
        return _blank(x)

    parts = []
    for rule in layout.rules:
        if rule[0] == "each":
            _, array, who, what = rule
            items = F.try_variant_get(record, f"$.{array}", "array<variant>")
            parts.append(F.transform(items, _turn_of(who, what, role)))
        else:
            parts.append(F.array(F.struct(F.lit(rule[1]).alias("role"), _blank(F.try_variant_get(record, f"$.{rule[2]}", "string")).alias("text"))))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _joint_turns(record: Column, layouts: tuple[Layout, ...]) -> Column:
    """Turns of all fields that the layouts speak of: system, user, the elements of arrays, assistant; null without a text.

    Different texts of one element are joined by a newline. A field whose text an element of its role has is not
    repeated, as prompt beside messages.
    """
    turn = "array<struct<role:string,text:string>>"
    arrays: dict[str, tuple[dict, dict, dict]] = {}
    fields: dict[tuple[str, str], None] = {}
    for layout in layouts:
        for rule in layout.rules:
            if rule[0] == "each":
                who, what, roles = arrays.setdefault(rule[1], ({}, {}, {}))
                who[rule[2]] = what[rule[3]] = None
                roles.update(layout.roles)
            else:
                fields[rule[1], rule[2]] = None

    def elements(array: str) -> Column:
        who, what, roles = arrays[array]

        def of(e: Column) -> Column:
            role = F.coalesce(*[F.try_variant_get(e, f"$.{w}", "string") for w in who])
            for old, new in roles.items():
                role = F.when(role == old, F.lit(new)).otherwise(role)
            texts = F.array_distinct(F.array_compact(F.array(*[F.try_variant_get(e, f"$.{w}", "string") for w in what])))
            return F.struct(_blank(role).alias("role"), F.when(F.size(texts) > 0, F.array_join(texts, "\n")).alias("text"))

        return F.coalesce(F.transform(F.try_variant_get(record, f"$.{array}", "array<variant>"), of), F.array().cast(turn))

    def single(*wanted: str) -> Column:
        found = [F.struct(F.lit(role).alias("role"), F.try_variant_get(record, f"$.{field}", "string").alias("text")) for role, field in fields if role in wanted]
        kept = F.filter(F.array(*found).cast(turn), lambda t: t["text"].isNotNull())
        return F.filter(kept, lambda t: ~F.exists(many, lambda m: m.eqNullSafe(t)))

    many = F.concat(*[elements(a) for a in arrays]) if arrays else F.array().cast(turn)
    others = sorted({role for role, _ in fields} - {"system", "user", "assistant"})
    turns = F.concat(single("system"), single("user", *others), many, single("assistant"))
    held = F.exists(turns, lambda t: t["text"].isNotNull())
    return F.when(held, F.transform(turns, lambda t: F.struct(t["role"].alias("role"), _blank(t["text"]).alias("text"))))


def canonical_turns(record: Column, mark: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Turns by the mapping that the fingerprint ``mark`` selects, those of all known fields where no layout has it."""
    out = _joint_turns(record, layouts)
    for layout in layouts:
        out = F.when(mark == path_hash(layout.paths), _turns(record, layout)).otherwise(out)
    return out


def escape(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    x = F.regexp_replace(x, r"<(?=/?s>)", r"<\\")
    return F.regexp_replace(x, r"\[(?=/?INST\])", r"[\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))), "")


#: Turns whose lengths are summed up in one go; sums over groups of turns keep long conversations from quadratic work.
TOGETHER = 256


def _running(lengths: Column) -> Column:
    """Sums of the lengths before each one, and of all at the end."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, start, lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once, as the element of an array that a function runs over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def loss_spans(turns: Column) -> Column:
    """Start (from 0) and length, in code points of the formatted string, of each text of the assistant."""
    sized = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("mine"), (F.length(escape(t["role"])) + len(OPEN) + len(MIDDLE)).cast("long").alias("head"), F.length(escape(t["text"])).cast("long").alias("body")))

    def group(part: Column) -> Column:
        return F.struct(part.alias("turns"), _running(F.transform(part, lambda t: t["head"] + t["body"] + len(CLOSE))).alias("sums"))

    def groups(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / TOGETHER).cast("int")), lambda k: _bound(F.slice(all_, k * TOGETHER + 1, TOGETHER), group))

    def spans(g: Column, at: Column) -> Column:
        places = F.transform(g["turns"], lambda t, i: F.struct(t["mine"].alias("mine"), (at + F.get(g["sums"], i) + t["head"]).alias("start"), t["body"].alias("length")))
        return F.transform(F.filter(places, lambda p: p["mine"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))

    def join(inner: Column) -> Column:
        offsets = _running(F.transform(inner, lambda g: F.element_at(g["sums"], -1)))
        return _bound(offsets, lambda o: F.flatten(F.transform(inner, lambda g, k: spans(g, F.get(o, k)))))

    return _bound(sized, lambda all_: _bound(groups(all_), join))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: the inverse of :func:`render`."""
    pieces = F.split(formatted, "</s>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        halves = F.split(F.substring(piece, len(OPEN) + 1, 2147483647), r" \[/INST\] ", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def format_records(df: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout_hash``, ``formatted`` and ``loss_spans``.

    The record column is a variant, a struct, or a JSON string. A record that mixes fields of several layouts gets the
    turns of all of them. Where the record is null, no JSON, or has no text in a known field, formatted and loss_spans
    are null; :func:`unmapped_counts` counts those. Null roles and texts count as empty. Input columns of these names are
    replaced. An empty table gives an empty table.
    """
    kind = dict(df.dtypes)[record_col]
    record = F.col(record_col)
    if kind == "string":
        record = F.try_parse_json(record)
    elif kind != "variant":
        record = F.to_variant_object(record)
    parsed, mark, said = free_names(df, "_chat_record", "_chat_mark", "_chat_turns")
    marked = df.withColumn(parsed, record).withColumn(mark, fingerprint(F.col(parsed), layouts))
    turns = marked.withColumn(said, canonical_turns(F.col(parsed), F.col(mark), layouts))
    out = turns.withColumn("layout_hash", F.col(mark)).withColumn("formatted", render(F.col(said))).withColumn("loss_spans", loss_spans(F.col(said)))
    return out.drop(parsed, mark, said)


def unmapped_counts(formatted: DataFrame) -> DataFrame:
    """(layout_hash, n_records) of the records that :func:`format_records` gave no text."""
    return formatted.where("formatted is null").groupBy("layout_hash").agg(F.count("*").alias("n_records"))


def collect_records(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one record per conversation, in order of turn (null last), role and text.

    Rows without a conv_id are one conversation. An empty table gives an empty table.
    """
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", _blank(F.col("role")).alias("role"), _blank(F.col("text")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", F.struct(messages.alias("messages")).alias("record"))
