"""Operator 9: chat formatting, in DataFrame functions only.

Each record is a variant. Its nested field paths are hashed to a schema fingerprint, and the
fingerprint selects a declarative mapping that turns the record into canonical turns. Turns are
written between control strings; texts and roles have the control characters escaped, so the
output can be parsed back, and spans of assistant text form the loss mask.

Cases: a null text or role is an empty one; a null order counts as first; turns with one order are
sorted by role, then text; repeated rows are repeated turns; a null conversation id is a
conversation; a conversation of any length is one string, so it must fit a task; extra columns are
ignored; records of an unknown layout are returned apart, never dropped in silence; empty tables
give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What each control character is written as inside a text; the escape character comes first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, MIDDLE, CLOSE = "<turn:", ">", "</turn>"


@dataclass(frozen=True)
class Layout:
    """paths: the record's nested field paths. turns: (role, path of its text) for flat records; or items: the path of a list whose elements have role and text. joined: paths added to the first turn."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    joined: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)


LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), role="$.role", text="$.text", order="$.turn"),
    Layout("messages", ("messages[].content", "messages[].role"), items="$.messages", role="$.role", text="$.content"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), items="$.conversations", role="$.from", text="$.value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("prompt_completion", ("completion", "prompt"), turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", ("input", "instruction", "output"), turns=(("user", "$.instruction"), ("assistant", "$.output")), joined=("$.input",)),
    Layout("system_prompt", ("prompt", "response", "system"), turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)


def nested(paths: tuple[str, ...]) -> str:
    """The paths as one nested list of names in order, as path_list() gives a record's."""
    tree: dict = {}
    for p in paths:
        at = tree
        for part in p.split("."):
            at = at.setdefault(part, {})

    def show(t: dict) -> str:
        return ",".join(k + (f"<{show(v)}>" if v else "") for k, v in sorted(t.items()))

    return show(tree)


def path_list(record: Column) -> Column:
    """A record's nested field paths without types: names in order, lists marked with []."""
    schema = F.schema_of_variant(record)
    bare = F.regexp_replace(schema, r": ARRAY<OBJECT<", "[]<")
    bare = F.regexp_replace(bare, r">>", ">")
    bare = F.regexp_replace(bare, r": OBJECT<", "<")
    bare = F.regexp_replace(bare, r": [A-Z]+(\([0-9, ]*\))?", "")
    bare = F.regexp_replace(bare, r"^OBJECT<|>$", "")
    return F.regexp_replace(bare, ", ", ",")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(path_list(record))


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _role(role: Column, layout: Layout) -> Column:
    for known, name in layout.roles.items():
        role = F.when(role == known, F.lit(name)).otherwise(role)
    return role


def _turn(order: Column, role: Column, text: Column) -> Column:
    return F.struct(order.cast("long").alias("turn"), role.alias("role"), text.alias("text"))


def _turns(record: Column, layout: Layout) -> Column:
    if layout.items:
        items = F.try_variant_get(record, layout.items, "array<variant>")
        return F.transform(items, lambda m, i: _turn(i, _role(_text(m, layout.role), layout), _text(m, layout.text)))
    if layout.turns:
        texts = [_text(record, path) for _, path in layout.turns]
        for path in layout.joined:
            extra = _text(record, path)
            texts[0] = F.when(extra == "", texts[0]).otherwise(F.concat(texts[0], F.lit("\n\n"), extra))
        return F.array(*[_turn(F.lit(i), F.lit(role), t) for i, ((role, _), t) in enumerate(zip(layout.turns, texts, strict=True))])
    return F.array(_turn(F.try_variant_get(record, layout.order, "long"), _role(_text(record, layout.role), layout), _text(record, layout.text)))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """records has id and record (variant). Returns id, turn, role, text of all turns, and the records that no layout fits (id, record, paths)."""
    marked = records.select("id", "record", path_list(F.col("record")).alias("paths")).withColumn("schema", F.xxhash64("paths"))
    chosen = None
    known = []
    for layout in layouts:
        key = F.xxhash64(F.lit(nested(layout.paths)))
        known.append(key)
        turns = _turns(F.col("record"), layout)
        chosen = F.when(F.col("schema") == key, turns) if chosen is None else chosen.when(F.col("schema") == key, turns)
    mapped = marked.select("id", F.explode(chosen).alias("t")).select("id", "t.*")
    other = marked.where(F.col("schema").isNull() | ~F.col("schema").isin(*known)).select("id", "record", "paths")
    return mapped, other


def escape(text: Column) -> Column:
    for char, code in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """id, formatted (all turns of a conversation as one string) and mask (array of start, length in code points: the escaped texts of loss_role)."""
    groups = turns.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"), escape(t["text"]).alias("body")))
    span = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.slice(F.array(span), 1, 0).alias("spans"))

    def add(acc, p):
        begin, size = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        mine = F.when(p["role"] == loss_role, F.array(F.struct(begin.alias("start"), size.alias("length")))).otherwise(F.slice(F.array(span), 1, 0))
        return F.struct((begin + size + len(CLOSE)).alias("at"), F.concat(acc["spans"], mine).alias("spans"))

    return groups.select("id", parts.alias("parts")).select(
        "id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("parts", zero, add, lambda acc: acc["spans"]).alias("mask"),
    )


def parse_turns(formatted: Column) -> Column:
    """Array of role and text, from the formatted string alone."""
    opens = F.filter(F.split(formatted, "<"), lambda x: F.startswith(x, F.lit(OPEN[1:])))
    bodies = F.transform(opens, lambda x: F.substring(x, F.lit(len(OPEN)), F.length(x)))
    return F.transform(bodies, lambda x: F.struct(unescape(F.substring_index(x, MIDDLE, 1)).alias("role"), unescape(F.substring(x, F.instr(x, MIDDLE) + 1, F.length(x))).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


CONTROL_TEXT = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    records = rows.unionByName(own).select(F.col("conv_id").alias("id"), F.to_variant_object(F.struct("turn", "role", "text")).alias("record"))
    turns, _ = canonical_turns(records)
    out = format_turns(turns)
    back = out.select(F.col("id").alias("conv_id"), "formatted", parse_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(text) + 14
    + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS n FROM turns)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
