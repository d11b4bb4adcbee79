"""Chat formatting by schema fingerprints (native).

A record arrives in whatever layout its producer chose: as JSON text, or as a typed struct whose null fields are the
layouts that it does not use. Its nested field paths, without types, are hashed to a fingerprint; the fingerprint
selects a declarative mapping (paths of the turns, the roles and the texts), and the mapping turns the record into
canonical (role, text) turns. Typed records never go through JSON. The template writes

    <|im_start|>role \\n text <|im_end|> \\n

and escapes control strings inside roles and texts reversibly: a backslash is doubled and "<|" becomes "<\\|", so
no text can hold a marker. `loss` has a flag for each marked turn: whether its text is under the loss mask (those of
assistant turns).

Defined cases: null or empty texts and roles are empty strings; a record of no turns formats to the empty
string; turns that tie on their number are ordered by role and text; a record whose fingerprint no mapping
knows has null turns (it is kept, for a report); a text counts whole, whatever its length up to what a Spark string
holds; a top-level field of a typed record is there if it is not null; extra fields inside a JSON record change its
fingerprint, extra columns beside it are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"

TURNS = "array<struct<role:string,text:string>>"

#: name -> (field paths of a record, mapping). A mapping is ("list", path, role field, text field) or ("fields", [(role, path), ...]).
LAYOUTS = {
    "messages": (["messages", "messages[].content", "messages[].role"], ("list", "messages", "role", "content")),
    "sharegpt": (["conversations", "conversations[].from", "conversations[].value"], ("list", "conversations", "from", "value")),
    "turns": (["turns", "turns[].speaker", "turns[].text"], ("list", "turns", "speaker", "text")),
    "completion": (["completion", "prompt"], ("fields", [("user", "prompt"), ("assistant", "completion")])),
    "response": (["prompt", "response"], ("fields", [("user", "prompt"), ("assistant", "response")])),
    "question": (["answer", "question"], ("fields", [("user", "question"), ("assistant", "answer")])),
    "instruction": (["instruction", "output"], ("fields", [("user", "instruction"), ("assistant", "output")])),
    "alpaca": (["input", "instruction", "output"], ("fields", [("user", "instruction"), ("user", "input"), ("assistant", "output")])),
    "system": (["prompt", "response", "system"], ("fields", [("system", "system"), ("user", "prompt"), ("assistant", "response")])),
}
#: Role names that producers use for the canonical ones.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: try_parse_json takes strings of 20,000,000 characters and variants of 128 MiB at most; from_json can be told otherwise.
LONG_RECORD = 10_000_000
UNBOUNDED = {"maxStringLen": str(2**31 - 1)}


def _skeleton(record: Column) -> Column:
    """A long record with its string values emptied; field names, which stand before a colon, stay."""
    bare = F.regexp_replace(F.regexp_replace(record, r"(?s)\\.", "_"), r'"([^"]*)"(\s*:)|"[^"]*"', '"$1"$2')
    return F.when(F.length(record) > LONG_RECORD, bare).otherwise(record)


def typed_fingerprint(record: Column, kind: StructType) -> Column:
    """The fingerprint of a typed record: of the paths below its fields that are not null."""
    pieces = []
    for field in sorted(kind.fields, key=lambda f: f.name):
        inner = field.dataType
        nested = isinstance(inner, ArrayType) and isinstance(inner.elementType, StructType)
        paths = [f"{field.name}[].{f.name}" for f in inner.elementType.fields] if nested else []
        pieces.append(F.when(record[field.name].isNotNull(), F.lit(_ddl([field.name, *paths])[len("OBJECT<") : -1])))
    return F.xxhash64(F.concat(F.lit("OBJECT<"), F.array_join(F.array_compact(F.array(*pieces)), ", "), F.lit(">")))


def fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON record: its variant schema without types, so that values never matter."""
    schema = F.schema_of_variant(F.try_parse_json(_skeleton(record)))
    untyped = F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z]\w*(\([0-9,]+\))?|(?<=ARRAY<)(?!OBJECT|ARRAY)[A-Z]\w*(\([0-9,]+\))?", "")
    return F.xxhash64(untyped)


def _ddl(paths: list[str]) -> str:
    """The untyped variant schema that a record with these field paths has."""
    top = sorted(p for p in paths if "[]" not in p)
    parts = []
    for name in top:
        inner = sorted(p.split("[].")[1] for p in paths if p.startswith(name + "[]."))
        parts.append(f"{name}: ARRAY<OBJECT<{', '.join(inner)}>>" if inner else name)
    return f"OBJECT<{', '.join(parts)}>"


def _mapped(record: Column, mapping) -> Column:
    if mapping[0] == "list":
        _, path, role, text = mapping
        items = F.from_json(record, f"`{path}` array<struct<`{role}`:string,`{text}`:string>>", UNBOUNDED)
        return F.transform(items[path], lambda m: F.struct(m[role].alias("role"), m[text].alias("text"))).cast(TURNS)
    fields = F.from_json(record, ",".join(f"`{p}` string" for _, p in mapping[1]), UNBOUNDED)
    return F.array(*(F.struct(F.lit(r).alias("role"), fields[p].alias("text")) for r, p in mapping[1])).cast(TURNS)


def _mapped_typed(record: Column, mapping) -> Column:
    if mapping[0] == "list":
        _, path, role, text = mapping
        return F.transform(record[path], lambda m: F.struct(m[role].alias("role"), m[text].alias("text"))).cast(TURNS)
    return F.array(*(F.struct(F.lit(r).alias("role"), record[p].alias("text")) for r, p in mapping[1])).cast(TURNS)


def canonical_turns(record: Column, layouts=LAYOUTS, names=ROLE_NAMES, kind: StructType | None = None) -> Column:
    """array of (role, text) by the mapping that the record's fingerprint selects; null if none does. kind: of a typed record."""
    turns = F.lit(None).cast(TURNS)
    key = fingerprint(record) if kind is None else typed_fingerprint(record, kind)
    for paths, mapping in layouts.values():
        if kind is not None and not {p.split("[")[0] for p in paths} <= set(kind.names):
            continue
        read = _mapped(record, mapping) if kind is None else _mapped_typed(record, mapping)
        turns = F.when(key == F.xxhash64(F.lit(_ddl(paths))), read).otherwise(turns)
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
    role = lambda t: F.coalesce(*([F.element_at(known, t["role"])] if names else []), t["role"], F.lit(""))
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def templated(turns: Column) -> Column:
    """The formatted string."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))), ""
    )


def parsed(formatted: Column) -> Column:
    """Back from the formatted string to (role, text) turns."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p):
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - 2 - len(END))
        return F.struct(unescaped(F.replace(head, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def format_chats(records: DataFrame, layouts=LAYOUTS, names=ROLE_NAMES) -> DataFrame:
    """records(conv_id, record: JSON text or a struct) -> conv_id, fingerprint, turns, loss, formatted.

    names: canonical names of roles that producers call otherwise; with an empty one roles stay as they are.
    """
    record, kind = F.col("record"), records.schema["record"].dataType
    kind = kind if isinstance(kind, StructType) else None
    key = fingerprint(record) if kind is None else typed_fingerprint(record, kind)
    out = records.select("conv_id", key.alias("fingerprint"), canonical_turns(record, layouts, names, kind).alias("turns"))
    return out.withColumns({"loss": F.transform("turns", lambda t: t["role"] == "assistant"), "formatted": templated(F.col("turns"))})


def records_of_rows(rows: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, record), a typed record for each conversation, turns in order.

    Conversations are stored in any layout that holds them, as different producers would: one whose roles are those of
    a layout of fields in one of these, any other in one of the layouts of lists, chosen by a hash of conv_id.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    lists = [n for n, (_, m) in layouts.items() if m[0] == "list"]
    flat: dict[tuple, list[str]] = {}
    for n, (_, m) in layouts.items():
        if m[0] == "fields":
            flat.setdefault(tuple(r for r, _ in m[1]), []).append(n)
    one_of = lambda own: F.element_at(F.array(*map(F.lit, own)), (F.pmod(F.xxhash64("conv_id"), F.lit(len(own))) + 1).cast("int"))
    chosen = one_of(lists)
    for roles, own in flat.items():
        chosen = F.when(F.col("t.role") == F.array(*map(F.lit, roles)), one_of(own)).otherwise(chosen)
    laid = grouped.withColumn("layout", chosen)
    fields: dict[str, Column] = {}
    for n, (_, m) in layouts.items():
        here = F.col("layout") == n
        if m[0] == "list":
            _, path, role, text = m
            parts = {path: F.col("t").cast(f"array<struct<turn:{rows.schema['turn'].dataType.simpleString()},`{role}`:string,`{text}`:string>>")}
            parts[path] = F.transform(parts[path], lambda x: F.struct(x[role], x[text]))
        else:
            parts = {path: F.get("t", F.lit(k))["text"] for k, (_, path) in enumerate(m[1])}
        for path, value in parts.items():
            fields[path] = F.when(here, value).otherwise(fields[path]) if path in fields else F.when(here, value)
    return laid.select("conv_id", F.struct(*(c.alias(n) for n, c in fields.items())).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the output holds: turns parsed from the formatted string, and those of them under the loss mask."""
    read = formatted.select("conv_id", "loss", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("read"))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("read", lambda t, k: F.get("loss", k)), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(F.encode(masked, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
