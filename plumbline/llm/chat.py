"""Chat formatting in DataFrame operations only.

Records come in many layouts: rows of turns, prompt and response, instruction with input and output, lists of messages
under several names. The nested field paths of a record, or of a table's schema, are hashed to a fingerprint, and the fingerprint selects a
declarative mapping to canonical turns. A record's paths come from walking its value, so what else it holds does not matter. A template marks the turns and escapes control strings inside roles and
texts; the escape is reversible, so the turns can be read back from what was formatted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed control strings of the template.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: What an escape breaks up inside roles and texts: the template's own mark and those of widespread templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"

Path = str


@dataclass(frozen=True)
class Mapping:
    """How a layout gives turns: fixed fields (``fields``: path and role, in order; absent or empty optional ones give no turn), then a
    list (``each``: its path, ``role`` and ``text``: fields within; a text may be a list of parts with texts), or rows (``rows``)."""

    name: str
    paths: tuple[Path, ...]
    each: Path = ""
    role: Path = "role"
    text: Path = "content"
    fields: tuple[tuple[Path, str], ...] = ()
    rows: tuple[Path, Path, Path, Path] | None = None


def _messages(name: str, at: str = "messages", system: bool = False) -> tuple[Mapping, ...]:
    """Messages whose contents are texts, lists of parts, or now one and now the other."""
    kinds = {"": (".content",), "_of_parts": (".content[].text",), "_mixed": (".content", ".content[].text")}
    first = (("system", "system"),) if system else ()
    return tuple(Mapping(name + k, (*("system",) * system, f"{at}[].role", *(f"{at}[]{t}" for t in texts)), each=at, fields=first) for k, texts in kinds.items())


#: The layouts that are known, by their field paths. ``[]`` stands for the elements of a list.
MAPPINGS = (
    Mapping("turn_rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    *_messages("messages"),
    *_messages("system_messages", system=True),
    *(m for w in ("data", "conversation", "record") for m in _messages(f"{w}_messages", f"{w}.messages")),
    *_messages("conversations", "conversations"),
    Mapping("messages_of_roles", ("messages[].role",), each="messages"),
    Mapping("no_messages", ("messages[]",), each="messages"),
    Mapping("turns", ("turns[].role", "turns[].text"), each="turns", text="text"),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value"),
    Mapping("prompt_response", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_input_response", ("input", "prompt", "response"), fields=(("prompt", "user"), ("input", "user"), ("response", "assistant"))),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question_answer", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
    Mapping("instruction_output", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_response", ("instruction", "response"), fields=(("instruction", "user"), ("response", "assistant"))),
    Mapping("instruction_input_response", ("input", "instruction", "response"), fields=(("instruction", "user"), ("input", "user"), ("response", "assistant"))),
    Mapping("instruction_input_output", ("input", "instruction", "output"), fields=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
)
#: Fields of a list's elements that hold a role and a text, in the order they are looked for after the layout's own.
ROLE_FIELDS, TEXT_FIELDS = ("role", "from"), ("content", "value", "text")
#: Levels of nesting that a record is walked down; what lies deeper is no part of any mapping.
DEPTH = 6
#: Roles of other layouts by their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_VOCABULARY = sorted({p for m in MAPPINGS for p in m.paths})


def fingerprint_of(paths: Column, known: Iterable[Path] = _VOCABULARY) -> Column:
    """Hash of the ``known`` ones among an array of field paths, sorted; other fields do not count."""
    known = F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in known])))
    return F.xxhash64(F.array_join(known, "\n"))


def fingerprint(paths: Iterable[Path]) -> int:
    """What fingerprint_of() gives for known paths: the signed XXH64 (seed 42) of the sorted ones, a line each."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(set(paths) & set(_VOCABULARY))).encode(), 42)
    return h - (h >> 63 << 64)


#: The mappings by their fingerprints.
BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def schema_paths(schema: T.DataType, at: str = "") -> list[Path]:
    """The nested field paths of a schema."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, at + "[]")
    return [at]


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping of a table whose columns are the record, by the same fingerprint as of single records.

    Other columns may share a name with another layout's fields: then the rows layout wins, if it is whole."""
    paths = set(schema_paths(schema))
    found = BY_FINGERPRINT.get(fingerprint(paths)) or next((m for m in MAPPINGS if m.rows and fingerprint(paths & set(m.paths)) == fingerprint(m.paths)), None)
    if not found:
        raise ValueError(f"no mapping for fields {sorted(paths)}")
    return found


def _turn(role: Column, text: Column) -> Column:
    named = F.coalesce(role.cast("string"), F.lit(""))
    for old, new in ROLES.items():
        named = F.when(named == old, F.lit(new)).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


_TURNS = "array<struct<role:string,text:string>>"


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table of turns, in the order of the turn numbers (ties by role and text).

    The mapping is chosen by the fingerprint of the table's fields; other columns, those that share a name with another layout's fields
    included, are not read."""
    m = mapping_of(rows.schema)
    if not m.rows:
        raise ValueError("not a table of turns")
    conv, turn, role, text = m.rows
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # a conversation is one value of the result, so its rows meet; nothing larger than a conversation does
    grouped = rows.groupBy(F.col(conv)).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return grouped.select(F.col(conv).alias("conv_id"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _part_text(content: Column) -> Column:
    """The text of a content: itself, or those of its parts, joined."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    return F.when(parts.isNull(), F.try_variant_get(content, "$", "string")).otherwise(F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), ""))


def _first_of(element: Column, names: Iterable[str], read) -> Column:
    """What ``read`` makes of the first field of these names that an element has, as a list of one; an empty list if it has none."""
    fields = F.try_variant_get(element, "$", "map<string,variant>")
    has = [(F.map_contains_key(fields, n), F.array(read(F.try_variant_get(element, f"$.{n}", "variant")))) for n in dict.fromkeys(names)]
    return reduce(lambda c, x: c.when(*x), has[1:], F.when(*has[0])).otherwise(F.array().cast("array<string>"))


def _list_turns(m: Mapping, record: Column) -> Column:
    """Turns of a list layout in a variant record. Each element is read by its own fields, so lists may mix layouts; null if one has no role, as its text would be lost."""
    elements = F.try_variant_get(record, f"$.{m.each}", "array<variant>")
    role = lambda t: _first_of(t, (m.role, *ROLE_FIELDS), lambda v: F.try_variant_get(v, "$", "string"))
    text = lambda t: _first_of(t, (m.text, *TEXT_FIELDS), _part_text)
    turns = F.transform(elements, lambda t: F.when(F.size(role(t)) > 0, _turn(F.get(role(t), F.lit(0)), F.get(text(t), F.lit(0)))))
    return F.when(~F.exists(turns, lambda t: t.isNull()), turns)


def _field_turns(m: Mapping, record: Column) -> Column:
    all_of = F.array(*[_turn(F.lit(role), F.try_variant_get(record, f"$.{path}", "string")) for path, role in m.fields])
    return F.filter(all_of, lambda t: (t["text"] != "") | (t["role"] == "assistant"))


def _record_turns(m: Mapping, record: Column) -> Column:
    if not m.each:
        return _field_turns(m, record)
    return F.concat(_field_turns(m, record), _list_turns(m, record)) if m.fields else _list_turns(m, record)


def record_paths(record: Column) -> Column:
    """The nested field paths of a variant record, as an array of strings: those of its values that are neither objects nor lists with
    elements, DEPTH levels down."""
    nodes = F.array(F.struct(F.lit("").alias("path"), record.alias("value")))
    none = F.array().cast("array<struct<path:string,value:variant>>")

    def below(n: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(n["value"], "$", "map<string,variant>"))
        elements = F.try_variant_get(n["value"], "$", "array<variant>")
        name = lambda f: F.concat(n["path"], F.when(n["path"] == "", "").otherwise("."), f["key"])
        inside = F.transform(fields, lambda f: F.struct(name(f).alias("path"), f["value"].alias("value")))
        each = F.transform(elements, lambda e: F.struct(F.concat(n["path"], F.lit("[]")).alias("path"), e.alias("value")))
        empty = F.array(F.struct(F.concat(n["path"], F.lit("[]")).alias("path"), F.lit(None).cast("variant").alias("value")))
        # a node that has nothing below it is kept for the next level
        return F.coalesce(F.when(F.size(inside) > 0, inside), F.when(F.size(each) > 0, each), F.when(F.size(elements) == 0, empty), F.array(n))

    for _ in range(DEPTH):
        nodes = F.flatten(F.transform(F.coalesce(nodes, none), below))
    return F.array_distinct(F.transform(nodes, lambda n: n["path"]))


def turns_of_records(records: DataFrame, record: str = "record") -> DataFrame:
    """All columns of ``records`` plus layout and turns, from a JSON text column of mixed layouts.

    A record has the first layout, of those with more fields before those with fewer, whose own fields it all has: fields that no layout or another one names change nothing. A record that is no JSON, or whose fields fit no mapping, gets a null layout and null turns: it is not dropped. A layout never stands
    beside null turns. Columns of the table named layout or turns are replaced."""
    parsed = records.withColumn("__v", F.try_parse_json(record))
    parsed = parsed.withColumn("__paths", F.when(F.col("__v").isNotNull(), record_paths(F.col("__v"))))
    per_record = sorted((m for m in MAPPINGS if not m.rows), key=lambda m: -len(m.paths))
    # the fingerprint of those of its paths that the mapping names
    own = reduce(lambda c, m: c.when(fingerprint_of(F.col("__paths"), m.paths) == fingerprint(m.paths), F.lit(m.name)), per_record, F.when(F.lit(False), F.lit("")))
    parsed = parsed.withColumn("__layout", own)
    layout = F.col("__layout")
    turns = reduce(lambda c, m: c.when(layout == m.name, _record_turns(m, F.col("__v"))), per_record, F.when(F.lit(False), F.lit(None).cast(_TURNS)))
    kept = [c for c in records.columns if c.lower() not in ("layout", "turns")]
    return parsed.withColumn("__turns", turns).select(*kept, F.when(F.col("__turns").isNotNull(), layout).alias("layout"), F.col("__turns").alias("turns"))


def escaped(text: Column) -> Column:
    """The text with no control string in it: a backslash breaks each up, and backslashes are doubled."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escaped(t["role"]), F.lit(BODY), escaped(t["text"]), F.lit(END))), "")


def read_back(text: Column) -> Column:
    """The turns of a formatted string. Marks stand in no escaped text, so it can be cut at them."""
    parts = F.filter(F.split(text, r"<\|turn\|>"), lambda p: p != "")
    body = lambda p: F.substring_index(p, BODY, -1)
    whole = lambda p: F.substring(body(p), F.lit(1), F.char_length(body(p)) - len(END))
    return F.transform(parts, lambda p: F.struct(unescaped(F.substring_index(p, BODY, 1)).alias("role"), unescaped(whole(p)).alias("text")))


def loss_spans(turns: Column) -> Column:
    """(start, length) in the formatted string of each assistant text: the loss mask, in code points."""
    sizes = F.transform(turns, lambda t: F.struct(F.char_length(escaped(t["role"])).alias("r"), F.char_length(escaped(t["text"])).alias("t"), (t["role"] == "assistant").alias("own")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        text = (acc["at"] + len(TURN) + s["r"] + len(BODY)).cast("bigint")
        span = F.array(F.struct(text.alias("start"), s["t"].cast("bigint").alias("length")))
        return F.struct((text + s["t"] + len(END)).cast("bigint").alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sizes, start, step, lambda acc: acc["spans"])


def masked(text: Column, spans: Column) -> Column:
    """What stands under the loss mask of a formatted string, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) to (conv_id, formatted, loss_spans).

    Defined cases: null roles and texts are empty; a conversation without turns is the empty string; equal turn numbers
    are put in order by role and text; a null conv_id is one conversation; an empty table gives an empty table; columns that
    belong to no layout are not read.
    """
    return turns.select("conv_id", formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss_spans"))
