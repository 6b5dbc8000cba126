"""Chat formatting (operator 4), by DataFrame functions alone.

Records are JSON texts of any layout, or structs. A record's field paths (`messages[].role`) that
some declared layout knows are sorted and hashed; the hash selects that layout's mapping to turns.
Turns are written with a marked template; control strings inside texts are escaped."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

START, END = "<|im_start|>", "<|im_end|>"
#: Spark's parser gives null for a text of more characters than this (and for over 128 MiB as a variant,
#: which no record of fewer bytes reaches).
PARSER_LIMIT = 20_000_000


@dataclass(frozen=True)
class Turns:
    """A list of turn objects: its field, the keys of role and text, and other names of roles."""

    field: str
    role: str
    text: str
    renamed: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return [f"{self.field}[].{self.role}", f"{self.field}[].{self.text}"]

    def turns(self, top: Column, typed: bool) -> Column:
        def turn(m: Column) -> Column:
            role = F.coalesce(m[self.role].cast("string"), F.lit(""))
            for old, new in self.renamed:
                role = F.when(role == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(m[self.text].cast("string"), F.lit("")).alias("text"))

        return F.transform(top[self.field] if typed else top[self.field].cast("array<map<string,variant>>"), turn)


@dataclass(frozen=True)
class Fields:
    """Top-level fields, one turn for each role: the texts of its fields that are not empty."""

    roles: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> list[str]:
        return [f for _, fields in self.roles for f in fields]

    def turns(self, top: Column, typed: bool) -> Column:
        def turn(role: str, fields: tuple[str, ...]) -> Column:
            texts = F.filter(F.array(*[top[f].cast("string") for f in fields]), lambda t: t.isNotNull() & (t != ""))
            return F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text"))

        return F.filter(F.array(*[turn(*r) for r in self.roles]), lambda t: (t["role"] != "system") | (t["text"] != ""))


MESSAGE_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS: dict[str, Turns | Fields] = {
    "messages": Turns("messages", "role", "content"),
    "messages_text": Turns("messages", "role", "text"),
    "conversations": Turns("conversations", "from", "value", MESSAGE_ROLES),
    "dialogue": Turns("dialogue", "speaker", "text", MESSAGE_ROLES),
    "instruction": Fields((("user", ("instruction",)), ("assistant", ("output",)))),
    "instruction_input": Fields((("user", ("instruction", "input")), ("assistant", ("output",)))),
    "instruction_system": Fields((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    "prompt_completion": Fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    "prompt_response": Fields((("user", ("prompt",)), ("assistant", ("response",)))),
    "question_answer": Fields((("user", ("question",)), ("assistant", ("answer",)))),
}


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def field_paths(top: Column) -> Column:
    """Paths of a map of variants: `a`, `a.b` for an object, `a[].b` for a list of objects."""

    def paths(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        return (F.when(kind.startswith("ARRAY<OBJECT"), F.transform(F.flatten(F.transform(e["value"].cast("array<map<string,variant>>"), F.map_keys)), lambda k: F.concat(e["key"], F.lit("[]."), k)))
                .when(kind.startswith("OBJECT"), F.transform(F.map_keys(e["value"].cast("map<string,variant>")), lambda k: F.concat(e["key"], F.lit("."), k)))
                .otherwise(F.array(e["key"])))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(top), paths))))


def schema_paths(record: StructType) -> list[str]:
    """Paths of a struct, as field_paths() gives them of a record."""

    def paths(name: str, kind) -> list[str]:
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            return [f"{name}[].{k}" for k in kind.elementType.names]
        return [f"{name}.{k}" for k in kind.names] if isinstance(kind, StructType) else [name]

    return [p for f in record.fields for p in paths(f.name, f.dataType)]


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undoes escape(): between escaped backslashes, `<\\|` is `<|`."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(p, F.lit("<\\|"), F.lit("<|"))), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|"))), "\\")


def format_chats(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """One row per record: id, layout, n_turns, formatted, loss_spans (array of code-point start and
    length of each assistant text in `formatted`), reason. A null, broken or undeclared record has a null
    layout, no turns and an empty text. A struct's layout is that of its type and its texts may be of
    any length; a JSON text that fails to parse and is longer than the parser may take has a `reason`
    that says so, which is null for all others: the caller gives such records as structs.
    Null roles and texts are empty. Other columns are ignored; repeated records give repeated rows.
    Turns keep their order, roles and texts exactly."""
    known = sorted({p for x in LAYOUTS.values() for p in x.paths()})
    kind = records.schema[record_col].dataType
    typed = isinstance(kind, StructType)
    own = fingerprint_of([p for p in schema_paths(kind) if p in known]) if typed else None
    given = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("top"))
    if typed:
        print_ = given.select("id", "top", F.lit(None).cast("string").alias("reason"), F.when(F.col("top").isNotNull(), F.lit(own)).alias("print"))
    else:
        top = given.select("id", F.octet_length("top").alias("size"), F.expr("try_parse_json(top)").alias("v"))
        lost = F.col("v").isNull() & (F.col("size") > PARSER_LIMIT)
        top = top.select("id", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v").cast("map<string,variant>")).alias("top"), F.when(lost, F.concat(F.lit("record too large to parse, bytes: "), F.col("size").cast("string"))).alias("reason"))
        print_ = top.select("id", "top", "reason", F.sha2(F.array_join(F.filter(field_paths(F.col("top")), lambda p: p.isin(known)), "\n"), 256).alias("print"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, x in LAYOUTS.items():
        if typed and fingerprint_of(x.paths()) != own:
            continue
        fits = F.col("print") == fingerprint_of(x.paths())
        layout = F.when(fits, F.lit(name)).otherwise(layout)
        turns = F.when(fits, x.turns(F.col("top"), typed)).otherwise(turns)
    chats = print_.select("id", "reason", layout.alias("layout"), F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        body = escape(t["text"])
        return F.struct(F.concat(head, body, F.lit(f"{END}\n")).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (t["role"] == "assistant").alias("loss"))

    pieces = chats.select("id", "reason", "layout", F.transform("turns", piece).alias("p"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))
        return F.struct((acc["at"] + p["head"] + p["body"] + len(END) + 1).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(F.col("id").alias(id_col), "layout", F.size("p").alias("n_turns"), F.array_join(F.col("p.piece"), "").alias("formatted"), F.aggregate("p", empty, step)["spans"].alias("loss_spans"), "reason")


def turns_of(formatted: Column) -> Column:
    """Reads the turns back from a formatted text: array of (role, text)."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations held as one row a turn, as `messages` records: (id, record as a struct). Turns are ordered
    by turn, then role, then text; null roles and texts are empty; rows of a null id form one record."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = rows.select(F.col(id_col).alias("_id"), turn.alias("_t")).groupBy("_id").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    return turns.select(F.col("_id").alias(id_col), F.struct(F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")).alias("record"))
