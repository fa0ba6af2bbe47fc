"""Chat formatting: any known record layout to canonical turns, and turns to one training string.

The nested field paths that a record or a table's schema has are hashed; the
fingerprint selects a declarative mapping, which turns prompt, instruction and
message layouts into ``array<struct<role, text>>``, and tables into turn rows.  Everything is column
expressions: no Python runs on the rows.

Template: ``<|im_start|>role NEWLINE text <|im_end|> NEWLINE`` per turn.  Control
strings inside roles and texts are broken up by an escape character, reversibly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
#: Escape character: itself doubled to ESC + "e"; ESC + "." breaks a control string; ESC + "n" is a newline in a role.
ESC = "␛"
#: The first character of anything that a chat template reads as control: <|..|>, <s>, </s>, <<SYS>>, [INST] and the like.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(ESC + "e")), f"({CONTROL})", f"$1{ESC}.")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "."), F.lit("")), F.lit(ESC + "e"), F.lit(ESC))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESC + "n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESC + "n"), F.lit("\n")))


#: Roles by the names that layouts use; any other role stays as it is.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(known[F.lower(raw)], raw, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _get(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _message_list(path: str, role: str, text: str) -> Callable[[Column], Column]:
    def build(record: Column) -> Column:
        items = F.coalesce(F.try_variant_get(record, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(items, lambda m: _turn(_role(F.try_variant_get(m, f"$.{role}", "string")), F.try_variant_get(m, f"$.{text}", "string")))

    return build


def _pair(question: str, answer: str, context: str | None = None) -> Callable[[Column], Column]:
    def build(record: Column) -> Column:
        asked = F.coalesce(_get(record, question), F.lit(""))
        if context:
            more = F.coalesce(_get(record, context), F.lit(""))
            asked = F.when(more == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), more))
        turns = F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), _get(record, answer)))
        system = _get(record, "system")
        return F.when(F.coalesce(system, F.lit("")) == "", turns).otherwise(F.concat(F.array(_turn(F.lit("system"), system)), turns))

    return build


@dataclass(frozen=True)
class Layout:
    """Field paths that make up a layout, and how its records become turns."""

    name: str
    paths: tuple[str, ...]
    build: Callable[[Column], Column]
    optional: tuple[str, ...] = ()


LAYOUTS = (
    Layout("messages", ("messages", "messages[].role", "messages[].content"), _message_list("messages", "role", "content")),
    Layout("messages_text", ("messages", "messages[].role", "messages[].text"), _message_list("messages", "role", "text")),
    Layout("messages_empty", ("messages",), _message_list("messages", "role", "content")),
    Layout("sharegpt", ("conversations", "conversations[].from", "conversations[].value"), _message_list("conversations", "from", "value")),
    Layout("sharegpt_empty", ("conversations",), _message_list("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output", "input"), ("input", "system")),
    Layout("instruction_response", ("instruction", "response"), _pair("instruction", "response", "context"), ("context", "system")),
    Layout("prompt_completion", ("prompt", "completion"), _pair("prompt", "completion"), ("system",)),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response"), ("system",)),
    Layout("question_answer", ("question", "answer"), _pair("question", "answer", "context"), ("context", "system")),
)
PATHS = tuple(sorted({p for x in LAYOUTS for p in (*x.paths, *x.optional)}))


def fingerprint_of(paths: Column) -> Column:
    """A layout's fingerprint: the hash of its known field paths in order; unknown extra fields don't change it."""
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, PATHS)))), "\n"), 256)


def _fingerprints(layout: Layout) -> list[Column]:
    """One fingerprint for each choice of optional fields."""
    found = []
    for mask in range(1 << len(layout.optional)):
        chosen = [p for i, p in enumerate(layout.optional) if mask >> i & 1]
        found.append(fingerprint_of(F.array(*map(F.lit, (*layout.paths, *chosen)))))
    return found


def record_fingerprint(record: Column) -> Column:
    """Of a variant: which known paths it has; ``x[].y`` is looked for in the first element."""
    present = F.array(*[F.when(F.try_variant_get(record, "$." + p.replace("[]", "[0]"), "variant").isNotNull(), F.lit(p)) for p in PATHS])
    return fingerprint_of(F.array_compact(present))


def canonical_turns(df: DataFrame, record_col: str, turns: str = "turns", layout: str = "layout") -> DataFrame:
    """Add ``turns`` and ``layout`` to rows whose ``record_col`` is a JSON text.

    Unknown layouts, malformed JSON and nulls give null for both; empty message
    lists give no turns.  Columns with the new names are replaced.
    """
    rows = df.drop(turns, layout).withColumn("__v", F.try_parse_json(F.col(record_col))).withColumn("__f", record_fingerprint(F.col("__v")))
    built, name = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for x in reversed(LAYOUTS):
        chosen = F.col("__f").isin(*_fingerprints(x))
        built, name = F.when(chosen, x.build(F.col("__v"))).otherwise(built), F.when(chosen, F.lit(x.name)).otherwise(name)
    return rows.withColumn(turns, built).withColumn(layout, name).drop("__v", "__f")


@dataclass(frozen=True)
class TableLayout:
    """How a table's columns hold turns: a row each (``turn`` orders them), or a list of structs (``items``)."""

    name: str
    conv: str
    role: str
    text: str
    turn: str | None = None
    items: str | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        if self.items:
            return (self.conv, self.items, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}")
        return (self.conv, self.turn, self.role, self.text)

    def build(self, df: DataFrame) -> DataFrame:
        none = F.lit("")
        if self.items:
            each = df.select(F.col(self.conv).alias("conv_id"), F.posexplode(self.items).alias("pos", "t"))
            number, role, text = F.struct(F.col("pos").cast("long").alias("turn"), none.alias("role"), none.alias("text")), F.col("t")[self.role], F.col("t")[self.text]
            return each.select("conv_id", number.alias("n"), F.coalesce(role, none).alias("role"), F.coalesce(text, none).alias("text"))
        role, text = F.coalesce(self.role, none), F.coalesce(self.text, none)
        return df.select(F.col(self.conv).alias("conv_id"), F.struct(F.col(self.turn).alias("turn"), role.alias("role"), text.alias("text")).alias("n"), role.alias("role"), text.alias("text"))


TABLES = (
    TableLayout("turn_rows", "conv_id", "role", "text", turn="turn"),
    TableLayout("message_rows", "conversation_id", "role", "content", turn="message_index"),
    TableLayout("turn_lists", "conv_id", "role", "text", items="turns"),
    TableLayout("message_lists", "conversation_id", "role", "content", items="messages"),
)


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema, ``x[].y`` for the fields of a list's structs."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    if not isinstance(kind, T.StructType):
        return set()
    found: set[str] = set()
    for field in kind:
        path = f"{prefix}.{field.name}" if prefix else field.name
        found |= {path} | schema_paths(field.dataType, path)
    return found


def _digest(paths: Iterable[str]) -> str:
    """What ``fingerprint_of`` gives, of paths that the driver knows."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


TABLE_OF = {_digest(x.paths): x for x in TABLES}


def turn_rows(df: DataFrame) -> DataFrame:
    """Turn rows (conv_id, n, role, text) of a table, by the mapping that the fingerprint of its schema selects.

    The schema's nested field paths are hashed, for each layout those that the
    layout knows, so that other columns change nothing; the first hash that is a
    layout's decides.  A table without any is refused.
    """
    present = schema_paths(df.schema)
    for layout in TABLES:
        found = TABLE_OF.get(_digest(present.intersection(layout.paths)))
        if found:
            return found.build(df)
    raise ValueError(f"no layout has the columns {df.columns}")


def render(rows: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation from ``turn_rows``: conv_id, formatted, turn_starts, loss_mask.

    ``turn_starts`` has the code point where each turn begins, ``loss_mask`` the
    code points [start, end) to train on in each turn, empty where the role is
    not trained.  Turns go by their number, ties by role and text; repeated rows
    are repeated turns; null roles and texts are empty; a null conv_id is one conversation.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    parts = rows.select("conv_id", "n", F.col("role").isin(*trained).alias("on"), head.alias("head"), body.alias("body"))
    parts = parts.withColumn("seg", F.concat("head", "body", F.lit(END))).withColumn("size", F.length("seg").cast("long")).withColumn("lead", F.length("head").cast("long")).withColumn("bare", F.length("body").cast("long")).drop("head", "body")
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))
    placed = parts.withColumn("at", start)
    begin = F.col("at") + F.col("lead")
    span = F.struct(begin.alias("start"), F.when(F.col("on"), begin + F.col("bare")).otherwise(begin).alias("end"))
    turns = F.array_sort(F.collect_list(F.struct("at", "seg", span.alias("span"))))
    return placed.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.col("t.seg"), "").alias("formatted"), F.col("t.at").alias("turn_starts"), F.col("t.span").alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, trained_text: what ``render`` wrote, parsed from its own output and unescaped."""
    segments = F.split(F.col("formatted"), r"<\|im_end\|>\n", -1)
    rows = formatted.withColumn("s", F.slice(segments, F.lit(1), F.size(segments) - 1))
    head = len(START)

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        return F.struct(unescape_role(F.substring(role, head + 1, 2**31 - 1 - head)).alias("role"), unescape(F.substr(s, F.length(role) + 2)).alias("text"))

    zipped = F.arrays_zip(F.col("s").alias("s"), F.col("turn_starts").alias("at"), F.col("loss_mask").alias("m"))
    masked = F.transform(zipped, lambda z: F.substr(z["s"], (z["m"]["start"] - z["at"] + 1).cast("int"), (z["m"]["end"] - z["m"]["start"]).cast("int")))
    return rows.select(*formatted.columns, F.transform("s", turn).alias("turns"), unescape(F.array_join(masked, "")).alias("trained_text"))
