"""Chat formatting with DataFrame functions only.

Layouts of prompts, instructions and messages are told apart by a fingerprint: a hash of their nested
field paths.  The fingerprint selects a declarative mapping, which turns a row into canonical turns
(role, text).  Turns are then written in one template whose control strings are escaped in texts, so
that a formatted conversation can be read back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"


# -- fingerprints and mappings


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted nested field paths; `[]` stands for the elements of an array.  Letter case is kept."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    paths: the layout's field paths.  fields: (role, path) of texts in order, each a turn if it isn't
    null (an empty system text is none either); a path pair "a+b" joins two fields by a line break.
    messages: instead, an array with the names of its role and text fields; with
    `rename`, other names of roles become the usual ones.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    rename: bool = False


#: Roles by other names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), (("user", "instruction+input"), ("assistant", "output"))),
    Mapping("system_instruction_input", ("input", "instruction", "output", "system"), (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), rename=True),
)
_TURNS = "array<struct<role:string,text:string>>"


def _role(c: Column, rename: bool) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[F.lower(c)], c, F.lit("")) if rename else F.coalesce(c, F.lit(""))


def _turns(mapping: Mapping, get) -> Column:
    """The turns of a row; get(path) is the field's column."""
    if mapping.messages:
        array, role, text = mapping.messages
        return F.coalesce(F.transform(get(array), lambda m: F.struct(_role(m[role], mapping.rename).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))), F.array().cast(_TURNS))
    turns = []
    for role, path in mapping.fields:
        parts = [F.nullif(get(p), F.lit("")) if k else get(p) for k, p in enumerate(path.split("+"))]
        text = F.concat_ws("\n", *parts)
        there = parts[0].isNotNull() if len(parts) == 1 else F.coalesce(*[p.isNotNull() for p in parts])
        turns.append(F.when(there & ((text != "") | F.lit(role != "system")), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.filter(F.array(*turns), lambda t: t.isNotNull()).cast(_TURNS)


def to_turns(df: DataFrame, record: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df with `layout` and `turns`.

    record: a string column of JSON records, each in a layout of its own; or a struct column; or None:
    the columns of df are the layout (those that are in no mapping are left aside as metadata).
    Unknown layouts, nulls and JSON that can't be read get a null layout and null turns.  A null text
    in a list of messages is an empty text, and a null field gives no turn.
    """
    if record and isinstance(df.schema[record].dataType, T.StringType):
        return _json_turns(df, record, mappings)
    schema = df.schema[record].dataType if record else df.schema
    used = {p.split("[]")[0].split(".")[0] for m in mappings for p in m.paths}
    own = [p for p in field_paths(schema) if record or p.split("[]")[0].split(".")[0] in used]
    get = lambda p: F.col(f"{record}.{p}" if record else f"`{p}`")
    found = {fingerprint(m.paths): m for m in reversed(mappings)}.get(fingerprint(own))
    if found is None:
        return df.withColumns({"layout": F.lit(None).cast("string"), "turns": F.lit(None).cast(_TURNS)})
    there = F.col(record).isNotNull() if record else F.lit(True)
    return df.withColumns({"layout": F.when(there, F.lit(found.name)), "turns": F.when(there, _turns(found, get))})


def _json_turns(df: DataFrame, record: str, mappings: tuple[Mapping, ...]) -> DataFrame:
    parsed = F.try_parse_json(F.col(record))
    # the schema of a record as text, without its leaf types: nested names and arrays in sorted order
    shape = F.regexp_replace(F.schema_of_variant(parsed), r": (STRING|VOID|BIGINT|BOOLEAN|DOUBLE|DECIMAL\([0-9, ]*\))", "")
    own = F.xxhash64(shape)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in mappings:
        if m.messages:
            array, role, text = m.messages
            kind = f"struct<`{array}`:array<struct<`{role}`:string,`{text}`:string>>>"
            names = ", ".join(sorted([role, text]))
            text_of = f"OBJECT<{array}: ARRAY<OBJECT<{names}>>>"
        else:
            kind = f"struct<{','.join(f'`{p}`:string' for p in m.paths)}>"
            text_of = f"OBJECT<{', '.join(sorted(m.paths))}>"
        fits = own == F.xxhash64(F.lit(text_of))
        read = F.from_json(F.col(record), T._parse_datatype_string(kind))
        layout = F.when(fits, F.lit(m.name)).otherwise(layout)
        turns = F.when(fits, _turns(m, lambda p, read=read: read[p])).otherwise(turns)
    return df.withColumns({"layout": layout, "turns": turns})


# -- the template


def escape(text: Column) -> Column:
    """`<|` never occurs in the result: every `<`, backslashes, `|` gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # a doubled backslash is set aside as a control string, which can't occur in an escaped role
    marked = F.replace(role, F.lit("\\\\"), F.lit("<|"))
    return unescape(F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("<|"), F.lit("\\")))


def format_turns(df: DataFrame, turns: str = "turns", train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """df with `formatted` and `loss_mask` for an array of (role, text).

    A turn is `<|im_start|>role\\ntext<|im_end|>\\n`.  loss_mask has an entry for each turn: for a
    role in train_on the span (start, length) of its text, in code points of the turn's own piece of
    `formatted`, which begins after its `<|im_start|>`; else null.  Null turns give an empty text and
    no entries; a null role or text is an empty one.
    """
    pieces = F.transform(
        F.coalesce(F.col(turns), F.array().cast(_TURNS)),
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), _escape_role(F.coalesce(t["role"], F.lit(""))).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body")
        ),
    )
    df = df.withColumn("_pieces", pieces)
    spans = F.transform(F.col("_pieces"), lambda p: F.when(p["role"].isin(*train_on), F.struct((F.length(p["head"]) + 2).alias("start"), F.length(p["body"]).alias("length"))))
    formatted = F.array_join(F.transform(F.col("_pieces"), lambda p: F.concat(F.lit(START), p["head"], F.lit("\n"), p["body"], F.lit(END + "\n"))), "")
    return df.withColumns({"formatted": formatted, "loss_mask": spans}).drop("_pieces")


def read_back(df: DataFrame, formatted: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """df with `read_turns` (role, text) and `loss_texts`, both taken from the formatted text alone and its mask."""
    pieces = F.filter(F.split(F.col(formatted), START.replace("|", r"\|")), lambda p, k: k > 0)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece) - F.length(head) - len(END) - 2)
        return F.struct(_unescape_role(head).alias("role"), unescape(body).alias("text"))

    under = F.zip_with(pieces, F.col(mask), lambda p, s: F.when(s.isNotNull(), unescape(F.substring(p, s["start"], s["length"]))))
    return df.withColumns({"read_turns": F.transform(pieces, turn), "loss_texts": F.filter(under, lambda x: x.isNotNull())})


def gather_turns(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turns) of a table with one row for each turn.

    Rows are ordered by turn, nulls first; equal turns by role, then text.  Repeated rows are turns of
    their own, and a null conversation id is a conversation.  A conversation is one row of the result,
    so that it must fit into memory.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    sorted_turns = F.array_sort(F.collect_list(one))
    return rows.groupBy(conversation).agg(F.transform(sorted_turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
