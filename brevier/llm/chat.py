"""Chat formatting: records of many layouts become canonical turns, turns become one marked text, and back.

Schema fingerprinting: a record (a variant: JSON text or a row) is known by the hash of its nested field paths, whatever
its values' types. The hash selects a declarative mapping, a Layout, that says where conversation, turn, role and text stand.
A new layout is a new mapping, no new code; records of unknown fingerprints are counted with their paths (`unmapped`).

The template marks turns by control strings, which are escaped inside texts: a backslash after the first character breaks
them up, and a backslash becomes two. No text can open or close a turn, and every text comes back as it was. Everything is
DataFrame functions, on the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = "array<struct<conv_id: bigint, turn: bigint, part: int, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Where a kind of record has its turns.

    paths: all nested field paths, with [] after an array's name; optional: paths that a record may have besides.
    Either turns = ((role, (path, ...)), ...) for fields of a fixed role, whose texts are joined by a blank line, null and
    empty ones left out, and no turn made of none; or each, role and text: an array's path and the paths in its elements;
    or role and text alone, for a record that is one turn. conv and turn: paths of the ids. roles: canonical names of roles.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str | None = None
    text: str | None = None
    conv: str | None = None
    turn: str | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


NAMES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}
TURN_ROW = Layout("turn row", ("conv_id", "turn", "role", "text"), role="role", text="text", conv="conv_id", turn="turn")
LAYOUTS = (
    TURN_ROW,
    Layout("messages", ("messages[].role", "messages[].content"), ("conv_id",), each="messages", role="role", text="content", conv="conv_id", roles=NAMES),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("conv_id",), each="conversations", role="from", text="value", conv="conv_id", roles=NAMES),
    Layout("prompt and response", ("prompt", "response"), ("conv_id", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), conv="conv_id"),
    Layout("prompt and completion", ("prompt", "completion"), ("conv_id", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), conv="conv_id"),
    Layout("instruction", ("instruction", "output"), ("conv_id", "input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), conv="conv_id"),
    Layout("nested example", ("example.question.text", "example.answer.text"), ("conv_id",), (("user", ("example.question.text",)), ("assistant", ("example.answer.text",))), conv="conv_id"),
)


@dataclass(frozen=True)
class Template:
    """What stands before a turn's role, between role and text, and after the text; and the control strings in these.

    A control string has two characters or more, and its first one nowhere else: so none overlaps another.
    """

    before: str = "<s>[INST] "
    between: str = " [/INST] "
    after: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c or any(c[0] in d[1:] for d in self.controls) for c in self.controls):
            raise ValueError("control strings must not overlap or hold a backslash")
        if not all(any(c in part for c in self.controls) for part in (self.between, self.after)):
            raise ValueError("a control string must stand between role and text, and after the text")


def structure(paths: tuple[str, ...]) -> str:
    """Nested field paths as one text: objects list their fields by name, arrays their elements' fields."""
    below: dict[str, list[str]] = {}
    for path in paths:
        name, _, rest = path.partition(".")
        below.setdefault(name, []).append(rest)
    parts = []
    for name in sorted(below, key=lambda n: n.removesuffix("[]").encode()):
        rest = [r for r in below[name] if r]
        inner = structure(tuple(rest)) if rest else ""
        parts.append(name.removesuffix("[]") + (f": ARRAY<{inner}>" if name.endswith("[]") else f": {inner}" if inner else ""))
    return f"OBJECT<{', '.join(parts)}>"


def structure_of(record: Column) -> Column:
    """The same text of each record: its schema without the types of values."""
    fields = F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+, ?\d+\))?(?=[,>])", "")
    return F.regexp_replace(fields, r"ARRAY<(?!OBJECT<|ARRAY<)[^<>]*>", "ARRAY<>")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def structures(layout: Layout) -> list[str]:
    """All structures of a layout: with and without each optional path; its array may be empty or null."""
    lists = [layout.paths]
    if layout.each:
        rest = tuple(p for p in layout.paths if not p.startswith(f"{layout.each}[]"))
        lists += [(*rest, f"{layout.each}[]"), (*rest, layout.each)]
    extra = [tuple(p for p, on in zip(layout.optional, chosen, strict=True) if on) for chosen in product((False, True), repeat=len(layout.optional))]
    return [structure((*paths, *more)) for paths in lists for more in extra]


def which_layout(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The place in layouts of the one that has the record's fingerprint; null if none has, or the record is null."""
    texts = [(k, s) for k, layout in enumerate(layouts) for s in structures(layout)]
    if len({s for _, s in texts}) < len(texts):
        raise ValueError("two layouts have the same paths")
    known = F.create_map(*[x for k, s in texts for x in (fingerprint(F.lit(s)), F.lit(k))])
    return F.element_at(known, fingerprint(structure_of(record)))


def at(record: Column, path: str | None, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind) if path else F.lit(None).cast(kind)


def turns_of(record: Column, layout: Layout) -> Column:
    """A record's turns, by its layout's mapping."""
    conv, turn = at(record, layout.conv, "bigint"), at(record, layout.turn, "bigint")

    def one(part: Column, role: Column, text: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None
        role = F.coalesce(F.element_at(names, role), role) if layout.roles else role
        return F.struct(conv.alias("conv_id"), turn.alias("turn"), part.cast("int").alias("part"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.turns:
        made = []
        for k, (role, paths) in enumerate(layout.turns):
            text = F.concat_ws("\n\n", *[F.nullif(at(record, p), F.lit("")) for p in paths])
            made.append(F.when(text != "", one(F.lit(k), F.lit(role), text)))
        return F.array_compact(F.array(*made)).cast(TURNS)
    if layout.each:
        items = at(record, layout.each, "array<variant>")
        found = F.transform(items, lambda m, k: one(k, at(m, layout.role), at(m, layout.text)))
        return F.coalesce(found.cast(TURNS), F.array().cast(TURNS))
    return F.array(one(F.lit(0), at(record, layout.role), at(record, layout.text))).cast(TURNS)


def turn_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of one row a turn as records; its other columns are left out."""
    named = zip((conv_col, turn_col, role_col, text_col), ("conv_id", "turn", "role", "text"), strict=True)
    return rows.select(F.to_variant_object(F.struct(*[F.col(c).alias(n) for c, n in named])).alias("record"))


def json_records(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """JSON texts as records; what isn't JSON is a null record."""
    return rows.select(F.try_parse_json(json_col).alias("record"))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, part, role, text) of all records of known fingerprints: (turn, part) orders a conversation.

    A null text is empty; a null role stays null. Records of no known layout give no turns, see `unmapped`. A record
    without a conversation's id belongs to the one named null.
    """
    chosen = records.select("record", which_layout(F.col("record"), layouts).alias("layout"))
    turns = F.lit(None).cast(TURNS)
    for k, layout in reversed([*enumerate(layouts)]):
        turns = F.when(F.col("layout") == k, turns_of(F.col("record"), layout)).otherwise(turns)
    return chosen.select(F.inline(turns))


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, structure, n) of the records that no layout maps; nulls, and texts that aren't JSON, under null."""
    lost = records.where(which_layout(F.col("record"), layouts).isNull())
    text = structure_of(F.col("record"))
    return lost.groupBy(fingerprint(text).alias("fingerprint"), text.alias("structure")).agg(F.count("*").alias("n"))


def escaped(text: Column, template: Template) -> Column:
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(text, rf"(\\|{heads})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(turns: DataFrame, template: Template = Template(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss) for each conversation of canonical turns.

    loss: (start, length) in code points, from 0, of each text, as escaped, that a loss is taken on; in order. Turns stand
    by turn (null first), part, role and text; repeated turns are repeated. A null role is empty. All turns of a
    conversation, and nothing of another, come together in one row, as the format asks.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("part"), F.asc_nulls_first("role"), "text")
    head = F.concat(F.lit(template.before), escaped(F.coalesce("role", F.lit("")), template), F.lit(template.between))
    pieces = (
        turns.select("conv_id", "turn", "part", "role", "text", head.alias("head"), escaped(F.col("text"), template).alias("body"))
        .withColumn("piece", F.concat("head", "body", F.lit(template.after)))
        .select(
            "conv_id",
            F.row_number().over(order).alias("k"),
            "piece",
            (F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece") + F.length("head")).alias("start"),
            F.length("body").cast("long").alias("length"),
            F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("counts"),
        )
    )
    listed = F.array_sort(F.collect_list(F.struct("k", "piece", "start", "length", "counts")))
    return pieces.groupBy("conv_id").agg(listed.alias("pieces")).select(
        "conv_id",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p["counts"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, as they were."""
    between = re.escape(template.between)
    parts = F.split(formatted, re.escape(template.after), -1)
    bodies = F.slice(parts, 1, F.size(parts) - 1)  # the last one is what follows the last turn: nothing
    split = F.transform(bodies, lambda b: F.split(F.substr(b, F.lit(len(template.before) + 1)), between, 2))
    return F.transform(split, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    cut = F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")
