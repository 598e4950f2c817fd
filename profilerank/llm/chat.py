"""Chat formatting: heterogeneous conversation layouts to one text with a loss mask.

The nested field paths of a table (or of each JSON record) are hashed; the hash
selects a declarative mapping to canonical turns.  All work on rows is done by
SQL expressions.

A turn is written ``<turn:role>text</turn>``.  Inside roles and texts the escape
sign and ``<`` (in roles ``>`` too) are replaced by two-letter escapes, so a control
string in a text can't end a turn and every text can be read back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

TURN = "array<struct<role string, text string>>"
OPEN, SHUT, CLOSE = "<turn:", ">", "</turn>"
TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (">", "\\g"))
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """``fields``: (role, column) pairs in order.  Or ``array`` with the names of its role and
    text.  Or ``rows``: (group, order, role, text) columns of a table with a row for each turn."""

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


LAYOUTS = (
    Layout("turn rows", ("role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("prompt", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system prompt", ("prompt", "response", "system"),
           fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"),
           fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("messages", ("messages", "messages.content", "messages.role"), array=("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations.from", "conversations.value"),
           array=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(kind: T.DataType, before: str = "") -> list[str]:
    """All nested field paths; an array has the paths of its elements."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, before)
    if not isinstance(kind, T.StructType):
        return []
    found = []
    for f in kind.fields:
        path = f"{before}.{f.name}" if before else f.name
        found += [path, *field_paths(f.dataType, path)]
    return found


def known_paths(layouts: tuple[Layout, ...]) -> set[str]:
    return {p for layout in layouts for p in layout.paths}


def layout_of(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout with the fingerprint of the table's schema.

    Paths that no layout names (extra columns) are left out of the hash; two
    layouts at once, or none, are an error that names the paths.
    """
    paths = known_paths(layouts) & set(field_paths(df.schema))
    found = {fingerprint(x.paths): x for x in layouts}.get(fingerprint(paths))
    if found is None:
        raise ValueError(f"no layout for the fields {sorted(paths)} of {sorted(field_paths(df.schema))}")
    return found


def escaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for raw, code in escapes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for raw, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _turn(role: Column, text: Column, layout: Layout) -> Column:
    for old, new in layout.roles.items():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _columns_to_turns(layout: Layout, at) -> Column:
    """Turns of a layout that holds a conversation in a row; ``at`` gives a field's column."""
    if layout.array:
        name, role, text = layout.array
        items = F.filter(F.coalesce(at(name), F.array()), lambda x: x.isNotNull())
        return F.transform(items, lambda x: _turn(x[role].cast("string"), x[text].cast("string"), layout))
    # an absent optional field makes no turn, an empty prompt or answer does
    return F.array_compact(F.array(*[
        F.when(at(c).isNotNull() if role == "system" or c == "input" else F.lit(True),
               _turn(F.lit(role), at(c).cast("string"), layout)) for role, c in layout.fields]))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, turns) of each conversation of a table in any known layout.

    Turn rows are ordered by (turn, role, text), nulls first; repeated rows stay.
    A null text or role is empty.  One row, hence one task, holds a conversation, as its
    output is one text.
    """
    layout = layout_of(df, layouts)
    if not layout.rows:
        return df.select(F.col(id_col).alias("conv_id"), _columns_to_turns(layout, F.col).alias("turns"))
    group, order, role, text = (F.col(c) for c in layout.rows)
    rows = df.select(group.alias("conv_id"), F.struct(
        order.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text")).alias("item"))
    return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
            .select("conv_id", F.transform("items", lambda x: _turn(x["role"], x["text"], layout)).alias("turns")))


def json_turns(df: DataFrame, json_col: str, id_col: str = "conv_id",
               layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turns) of JSON records that may each have another layout.

    The fingerprint is taken of each record's own keys, and of those of the first
    element of its lists.  A record of no layout, or no JSON, has null layout and turns.
    """
    layouts = tuple(x for x in layouts if not x.rows)
    known, record = sorted(known_paths(layouts)), F.col(json_col)
    lists = sorted({x.array[0] for x in layouts if x.array})
    keys = [F.coalesce(F.json_object_keys(record), F.array())]
    for name in lists:
        first = F.json_object_keys(F.get_json_object(record, f"$.{name}[0]"))
        keys.append(F.transform(F.coalesce(first, F.array()), lambda k: F.concat(F.lit(f"{name}."), k)))  # noqa: B023
    paths = F.array_sort(F.array_intersect(F.array_distinct(F.concat(*keys)), F.array(*[F.lit(p) for p in known])))
    mark = F.sha2(F.array_join(paths, "\n"), 256)
    turns, name = F.lit(None).cast(TURN), F.lit(None).cast("string")
    for layout in layouts:
        if layout.array:
            array, role, text = layout.array
            schema = f"`{array}` array<struct<`{role}` string, `{text}` string>>"
        else:
            schema = ", ".join(f"`{c}` string" for _, c in layout.fields)
        read = F.from_json(record, schema)
        hit = F.col("_mark") == fingerprint(layout.paths)
        turns = F.when(hit, _columns_to_turns(layout, lambda c: read[c])).otherwise(turns)  # noqa: B023
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
    return df.withColumn("_mark", mark).select(F.col(id_col).alias("conv_id"), name.alias("layout"), turns.alias("turns"))


def formatted(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans): the text, and the code points to learn from as (start, length)."""
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(SHUT))
    parts = turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("spans"))

    def step(acc, p):
        at = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(at.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((at + F.length(p["body"]) + len(CLOSE)).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return parts.select("conv_id", text.alias("formatted"),
                        F.aggregate("parts", start, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, SHUT, 1), len(OPEN) + 1, 1 << 30), ROLE_ESCAPES).alias("role"),
        unescaped(p.substr(F.instr(p, SHUT) + 1, F.length(p))).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """What stands under the mask, unescaped."""
    return F.array_join(F.transform(
        spans, lambda s: unescaped(text.substr(s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted text."""
    seen = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
