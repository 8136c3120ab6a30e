"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a template marks the turns.

A row's fingerprint hashes the sorted nested field paths that it fills, among those that a mapping knows; the mapping that
has this fingerprint, with or without its optional paths, turns the row into `turns array<struct<role,text>>`. Paths that no mapping knows do not matter.

The template is <|im_start|>role<|im_sep|>text<|im_end|> for each turn. Inside roles and texts every '<', '[' and '\\'
is followed by an added '\\', so that no control string of this or of a bracketed template can appear there;
dropping the character after each of the three gives the text back. The loss mask is a list of code-point spans of the
assistant's texts in the output.

Defined results: null text or role is empty; a row that no mapping knows has null turns and fingerprint of its paths;
turns with equal numbers are ordered by role and text, repeated rows stay; a null conversation id is a conversation of
its own; no rows give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the nested field paths that a row always fills and those that it may fill, at top level or below.

    Turns are (role, fields joined by blank lines), where one of optional fields alone is left out if they are null; or the
    structs of a column, a list or one, by its fields role and text. as_is: roles stay as they are written.
    """

    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    as_is: bool = False

    def fingerprints(self) -> list[str]:
        """The filled paths, sorted and joined, of every row that has this layout."""
        subsets = (c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n))
        return ["|".join(sorted((*self.paths, *c))) for c in subsets]


def _fields(user: tuple[str, ...], assistant: str, optional: tuple[str, ...] = ()) -> Mapping:
    required = tuple(f for f in (*user, assistant) if f not in optional)
    return Mapping(required, ("system", *optional), turns=(("system", ("system",)), ("user", user), ("assistant", (assistant,))))


def _messages(column: str, role: str, text: str) -> Mapping:
    return Mapping((column,), ("system", f"{column}[].{role}", f"{column}[].{text}"), (("system", ("system",)),), column, role, text)


MAPPINGS = (
    _messages("messages", "role", "content"),
    _messages("conversations", "from", "value"),
    _fields(("prompt",), "completion"),
    _fields(("prompt",), "response"),
    _fields(("instruction", "input"), "output", ("input",)),
    _fields(("question",), "answer"),
    #: One turn in a row of its own.
    Mapping(("message",), ("message.role", "message.text"), messages="message", role="role", text="text", as_is=True),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def filled_paths(schema: T.StructType) -> dict[str, Callable[[Column], Column]]:
    """Path -> whether a value of the schema fills it, for every field at any depth; an array adds [] to the paths in it.

    A struct or array is filled if it is not null, a path inside an array if any element fills it.
    """
    out: dict[str, Callable[[Column], Column]] = {}
    for f in schema.fields:
        out[f.name] = lambda row, name=f.name: row[name].isNotNull()
        for path, test in _below(f.dataType).items():
            out[f.name + path] = lambda row, name=f.name, test=test: F.coalesce(test(row[name]), F.lit(False))
    return out


def _below(kind: T.DataType) -> dict[str, Callable[[Column], Column]]:
    if isinstance(kind, T.StructType):
        return {f".{path}": test for path, test in filled_paths(kind).items()}
    if isinstance(kind, T.ArrayType):
        return {f"[]{path}": lambda x, test=test: F.exists(x, lambda e: test(e)) for path, test in _below(kind.elementType).items()}
    return {}


def canonical_role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(known[F.lower(F.coalesce(role, F.lit("")))], role, F.lit(""))


def _message(m: Mapping):
    role = (lambda r: F.coalesce(r, F.lit(""))) if m.as_is else canonical_role
    return lambda x: F.struct(role(x[m.role].cast("string")).alias("role"), F.coalesce(x[m.text].cast("string"), F.lit("")).alias("text"))


def _made(df: DataFrame, m: Mapping) -> Column:
    parts = []
    for role, names in m.turns:
        there = [f for f in names if f in df.columns]
        if not there:
            continue
        told = F.concat_ws("\n\n", *[F.nullif(df[f].cast("string"), F.lit("")) for f in there])
        turn = F.array(F.struct(F.lit(role).alias("role"), told.alias("text"))).cast(TURNS)
        parts.append(turn if set(there) - set(m.optional) else F.when(F.coalesce(*[df[f].cast("string") for f in there]).isNotNull(), turn).otherwise(F.array().cast(TURNS)))
    if m.messages:
        listed = df[m.messages] if isinstance(df.schema[m.messages].dataType, T.ArrayType) else F.array(df[m.messages])
        parts.append(F.transform(listed, _message(m)).cast(TURNS))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def canonical_turns(df: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """df of mixed layouts -> its columns, with schema_fingerprint (long) and turns (null where no mapping has the fingerprint)."""
    known = {p for m in mappings for p in (*m.paths, *m.optional)}
    filled = {p: test for p, test in filled_paths(df.schema).items() if p in known}
    there = [F.when(test(df), F.lit(p)) for p, test in sorted(filled.items())]
    fingerprint = F.xxhash64(F.concat_ws("|", *there) if there else F.lit(""))
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        below = {p for p in m.optional if m.messages and p.startswith(m.messages)}
        if {*m.paths, *below} <= set(filled):
            turns = F.when(fingerprint.isin([F.xxhash64(F.lit(f)) for f in m.fingerprints()]), _made(df, m)).otherwise(turns)
    extra = [c for c in df.columns if c not in ("schema_fingerprint", "turns")]
    return df.select(*[df[c] for c in extra], fingerprint.alias("schema_fingerprint"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\\<\[]", r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def turn_rows(df: DataFrame, conv: str = "conv_id", turns: str = "turns", order: str | None = None) -> DataFrame:
    """A row for each turn of canonical turns: conv, turn, role, text.

    A row that no mapping knows (null turns) stays, as one row with null role and text. order: a column that numbers the
    rows of a conversation, where it has several; turn is then (order, place in the row).
    """
    made = df.select(F.col(conv), *([F.col(order).alias("of_row")] if order else []), F.posexplode_outer(turns).alias("at", "t"))
    turn = F.struct("of_row", "at") if order else F.col("at")
    return made.select(conv, turn.alias("turn"), "t.role", "t.text")


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn=("assistant",)) -> DataFrame:
    """Turn rows -> (conv, formatted, loss_spans array<struct<start,end>>), one row for each conversation.

    Offsets are running sums over the conversation's rows, so a long conversation is windowed with spilling.
    """
    who = F.coalesce(rows[role].cast("string"), F.lit(""))
    told = F.coalesce(rows[text].cast("string"), F.lit(""))
    r = rows.select(rows[conv].alias("conv"), rows[turn].alias("turn"), who.alias("role"), told.alias("text"))
    r = r.withColumn("head", F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))).withColumn("body", escaped(F.col("text")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    r = r.withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)) + F.length("head"))
    ends = F.col("at") + F.length("body")
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), F.col("role").isin(*learn).alias("learn"), ends.alias("end"))
    grouped = r.groupBy("conv").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x.learn), lambda x: F.struct(x.at.alias("start"), x.end.alias("end")))
    return grouped.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("p", lambda x: x.piece), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: array<struct<role,text>>."""
    pieces = F.split(formatted, r"<\|im_end\|>")
    bodies = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescaped(F.substring_index(b, SEP, 1)).alias("role"),
            unescaped(F.substr(b, F.length(F.substring_index(b, SEP, 1)) + len(SEP) + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
