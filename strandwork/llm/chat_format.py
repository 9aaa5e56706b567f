"""Chat formatting: layouts are found by fingerprint and written as one template.

A layout is a set of nested field paths. The hash of the known paths that a
table (or a JSON record) has picks a declared mapping, and the mapping turns the
layout into canonical turns: an array of (role, text). Everything is made of
DataFrame expressions.

The template writes a turn as ``### role: text</turn>`` and a line break. In
roles and texts the characters that it uses are escaped, so no text can open or
close a turn, and reading back gives every text unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
# Fixed values of the escape: the mark itself first. An escaped character is the
# mark and a letter, so units never overlap and can be undone one kind after another.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def escape(column: Column, role: bool = False) -> Column:
    """Free of ``#`` and ``<``; a role is free of ``:`` as well."""
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        column = F.replace(column, F.lit(plain), F.lit(code))
    return column


def unescape(column: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        column = F.replace(column, F.lit(code), F.lit(plain))
    return column


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _messages(path: str, role: str, text: str) -> Callable[[Column], Column]:
    def turns(c: Column) -> Column:
        listed = F.coalesce(c(path), F.array())
        return F.transform(listed, lambda m: _turn(m[role], m[text]))

    return turns


def _pair(first: str, second: str, extra: str | None = None, system: str | None = None) -> Callable[[Column], Column]:
    def turns(c: Column) -> Column:
        ask = F.coalesce(c(first), F.lit(""))
        if extra:
            ask = F.when(F.coalesce(c(extra), F.lit("")) == "", ask).otherwise(F.concat(ask, F.lit("\n\n"), c(extra)))
        pair = F.array(_turn("user", ask), _turn("assistant", c(second)))
        if system is None:
            return pair
        head = F.when(F.coalesce(c(system), F.lit("")) == "", F.array().cast(TURNS)).otherwise(F.array(_turn("system", c(system))))
        return F.concat(head, pair)

    return turns


#: Declared layouts: their field paths and how they become turns.
LAYOUTS: dict[tuple[str, ...], Callable] = {
    ("messages[].content", "messages[].role"): _messages("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _messages("conversations", "from", "value"),
    ("prompt", "response"): _pair("prompt", "response"),
    ("completion", "prompt"): _pair("prompt", "completion"),
    ("prompt", "response", "system"): _pair("prompt", "response", system="system"),
    ("instruction", "output"): _pair("instruction", "output"),
    ("input", "instruction", "output"): _pair("instruction", "output", "input"),
    ("input", "instruction", "output", "system"): _pair("instruction", "output", "input", "system"),
    ("answer", "question"): _pair("question", "answer"),
}
#: Rows of single turns; they are gathered before they are formatted.
TURN_ROWS = ("conv_id", "role", "text", "turn")
_KNOWN = {p for paths in LAYOUTS for p in paths} | set(TURN_ROWS)


def _paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return _paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths) -> str:
    """A name for a set of field paths; unknown paths do not count."""
    known = sorted({p for p in paths if p in _KNOWN})
    value = 0xCBF29CE484222325
    for byte in "|".join(known).encode():
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return f"{value:016x}"


_BY_PRINT = {fingerprint(paths): turns for paths, turns in LAYOUTS.items()}


def canonical_turns(df: DataFrame, out: str = "turns") -> DataFrame:
    """``df`` with ``out``, its turns, by the layout that its schema's fingerprint names.

    Rows of single turns (``conv_id, turn, role, text``) are gathered to (conv_id,
    turns), ordered by turn, role and text with nulls first; a conversation is one
    row of the result. Null roles and texts are empty, repeated rows repeat a
    turn, further columns are left alone (or dropped where rows are gathered).
    A layout that is not declared is an error.
    """
    mark = fingerprint(_paths(df.schema))
    if mark == fingerprint(TURN_ROWS):
        row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        gathered = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
        return gathered.select("conv_id", F.transform("rows", lambda r: _turn(r["role"], r["text"])).alias(out))
    if mark not in _BY_PRINT:
        raise ValueError(f"no mapping for the layout {sorted(_paths(df.schema))}")
    return df.withColumn(out, _BY_PRINT[mark](F.col).cast(TURNS))


def canonical_turns_json(df: DataFrame, column: str, out: str = "turns") -> DataFrame:
    """The same for one JSON record per row, where every row may have another layout.

    The paths of a record are its top-level keys and, for the declared lists, the
    keys of the first element. ``out`` is null where no mapping is declared.
    """
    record = F.col(column)
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    lists = sorted({p.split("[]")[0] for p in _KNOWN if "[]" in p})
    nested = [_prefixed(record, name) for name in lists]
    known = F.array(*[F.lit(p) for p in sorted(_KNOWN)])
    found = F.array_join(F.array_sort(F.array_intersect(F.array_distinct(F.concat(top, *nested)), known)), "|")
    choice = F.lit(None).cast(TURNS)
    for paths, turns in LAYOUTS.items():
        keys: dict[str, list[str]] = {}
        for name, _, key in (p.partition("[].") for p in paths):
            keys.setdefault(name, []).extend([key] if key else [])
        kinds = {n: f"array<struct<{', '.join(f'`{k}`: string' for k in ks)}>>" if ks else "string" for n, ks in keys.items()}
        parsed = F.from_json(record, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))
        choice = F.when(F.xxhash64(found) == F.xxhash64(F.lit("|".join(sorted(paths)))), turns(lambda n, parsed=parsed: parsed[n]).cast(TURNS)).otherwise(choice)
    return df.withColumn(out, choice)


def _prefixed(record: Column, name: str) -> Column:
    keys = F.json_object_keys(F.get_json_object(record, f"$.{name}[0]"))
    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{name}[]."), k))


def format_chat(df: DataFrame, turns: str = "turns", out: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """``df`` with the formatted conversation and the loss mask as spans.

    A span (``start``, ``length`` in code points of ``out``) covers the escaped
    text of one assistant turn. No turns, or null, give an empty text.
    """
    parts = F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(SEPARATOR)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == TRAINED_ROLE).alias("trained"),
    ))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        head, body = F.length(p["head"]).cast("long"), F.length(p["body"]).cast("long")
        here = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct(
            (acc["at"] + head + body + len(CLOSE)).alias("at"),
            F.when(p["trained"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"),
        )

    written = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return df.withColumns({out: written, spans: F.aggregate(parts, start, step, lambda acc: acc["spans"])})


def read_chat(df: DataFrame, formatted: str = "formatted", out: str = "turns_read") -> DataFrame:
    """``df`` with the turns that stand in the formatted text."""
    pieces = F.filter(F.split(F.col(formatted), CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, SEPARATOR)
        role = F.substring(p, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return _turn(unescape(role), unescape(F.substring(p, cut + len(SEPARATOR), F.length(p))))

    return df.withColumn(out, F.transform(pieces, turn))


def read_loss_texts(df: DataFrame, formatted: str = "formatted", spans: str = "loss_spans", out: str = "loss_texts") -> DataFrame:
    """``df`` with the texts under the loss mask, unescaped, in order."""
    return df.withColumn(out, F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
