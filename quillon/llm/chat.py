"""Chat formatting by schema fingerprints, with DataFrame operations only.

A conversation is one JSON document in any known layout. Its fingerprint is the hash of its nested field paths; the
fingerprint selects a declarative mapping, and the mapping turns the document into canonical turns of role and text.
Turns are written with a template that marks them, control strings inside texts are escaped, and a loss mask lists the
spans of assistant texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.json_paths import field_paths
from quillon.llm.shared import numbered

#: Control strings of the template, and the escapes that stand for them inside texts. The backslash comes first.
TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>"
ESCAPES = (("\\", "\\b"), (TURN_START, "\\s"), (TURN_END, "\\e"))
#: A role also escapes what ends it.
ROLE_ESCAPES = (*ESCAPES, (ROLE_END, "\\r"))
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """A layout: fields that are present, fields that may be, and where its turns are.

    turns lists (role, JSON path) of scalar fields in the order of turns; a path that is absent or null in an optional
    field gives no turn, a null required text an empty one. messages is (path of the array, role field, text field).
    Roles stay as they are given, or, with renamed, take their canonical names. Optional fields that no turn names, such
    as an id, change nothing.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    renamed: bool = False

    def layouts(self) -> list[tuple[str, ...]]:
        """Every set of field paths that this mapping stands for."""
        return [tuple(sorted((*self.required, *(o for o, on in zip(self.optional, chosen) if on)))) for chosen in product((False, True), repeat=len(self.optional))]


MAPPINGS = (
    Mapping("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), ("id", "messages[].name"), messages=("$.messages", "role", "content")),
    Mapping("conversations", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), ("id",), messages=("$.conversations", "from", "value"), renamed=True),
    Mapping("instruction", ("instruction", "output"), ("id", "input", "system"), turns=(("system", "$.system"), ("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("prompt", ("prompt", "response"), ("id", "system"), turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("completion", ("completion", "prompt"), ("id",), turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("question", ("answer", "question"), ("context", "id"), turns=(("user", "$.context"), ("user", "$.question"), ("assistant", "$.answer"))),
)


def fingerprint_of(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def _message(role: str, text: str, renamed: bool):
    named = canonical_role if renamed else lambda r: F.coalesce(r, F.lit("user"))
    return lambda v: F.struct(named(F.try_variant_get(v, f"$.{role}", "string")).alias("role"), F.coalesce(F.try_variant_get(v, f"$.{text}", "string"), F.lit("")).alias("text"))


def canonical_turns(df: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df plus fingerprint, layout (mapping name or null) and turns: array<struct<role, text>>.

    A document that is null, not JSON or of an unknown layout has a null layout and null turns. A null element of a
    message array is left out; a null role is "user", a null text is empty. The mappings are constants, so no join is needed.
    """
    marked = df.withColumn("fingerprint", fingerprint_of(field_paths(F.try_parse_json(F.col(json_col)), quoted=True)))
    doc = F.try_parse_json(F.col(json_col))
    layout = turns = None
    for m in mappings:
        prints = [hashlib.sha256("\n".join(p).encode()).hexdigest() for p in m.layouts()]
        this = F.col("fingerprint").isin(prints)
        if m.messages:
            path, role, text = m.messages
            found = F.transform(F.filter(F.try_variant_get(doc, path, "array<variant>"), lambda v: ~F.is_variant_null(v)), _message(role, text, m.renamed))
        else:
            required = {f"$.{p}" for p in m.required}
            each = [F.struct(F.lit(r).alias("role"), (F.coalesce(F.try_variant_get(doc, p, "string"), F.lit("")) if p in required else F.try_variant_get(doc, p, "string")).alias("text")) for r, p in m.turns]
            found = F.filter(F.array(*each), lambda t: t["text"].isNotNull())
        layout = F.when(this, m.name) if layout is None else layout.when(this, m.name)
        turns = F.when(this, found) if turns is None else turns.when(this, found)
    return marked.withColumn("layout", layout).withColumn("turns", turns)


def canonical_role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(named[F.coalesce(role, F.lit(""))], role, F.lit("user"))


def escaped(text: Column, escapes: tuple = ESCAPES) -> Column:
    """Reversible: afterwards no control string is left, and every backslash starts an escape."""
    for control, code in escapes:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for control, code in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def formatted(df: DataFrame, turns_col: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """df plus formatted (one string) and loss_spans: array<struct<start, length>> in code points of formatted.

    A span covers the escaped text of one turn of trained_role, by whatever of its names, without its marks. Null turns give null results, no
    turns an empty string.
    """
    bare, (turns_col,), columns = numbered(df.drop("formatted", "loss_spans"), turns_col)
    parts = F.transform(turns_col, lambda t: F.struct(
        F.concat(F.lit(TURN_START), escaped(t["role"], ROLE_ESCAPES), F.lit(ROLE_END)).alias("head"), escaped(t["text"]).alias("body"), (canonical_role(t["role"]) == trained_role).alias("trained")))
    written = bare.withColumn("_parts", parts).withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END + "\n"))), ""))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    tail = len(TURN_END) + 1

    def step(acc: Column, p: Column) -> Column:
        head, body = F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct((acc["at"] + head).cast("long").alias("start"), body.cast("long").alias("length")))
        return F.struct((acc["at"] + head + body + tail).cast("long").alias("at"), F.when(p["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return written.select(*columns, "formatted", F.aggregate("_parts", begin, step, lambda acc: acc["spans"]).alias("loss_spans"))


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    pieces = F.split(text, TURN_END + "\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ROLE_END, 1)
        role = F.substr(head, F.lit(len(TURN_START) + 1))
        body = F.substr(p, F.length(head) + len(ROLE_END) + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversations_as_json(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, json: rows by turn gathered into the messages layout; order by turn, then role, text. A null text is empty, a null role "user".

    Rows with a null id are one conversation, with a null id.

    One conversation is one unit of output, so its turns meet in one row.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    gathered = rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return gathered.select(F.col("id").alias(id_col), F.to_json(F.struct(messages.alias("messages"))).alias("json"))


def format_chat(df: DataFrame, json_col: str = "json", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """df plus fingerprint, layout, turns, formatted and loss_spans, for documents of any known layout.

    Columns of those names are replaced. Rows without a known layout stay, with nulls. An empty table gives an empty
    result; repeated rows stay.
    """
    bare = df.drop("fingerprint", "layout", "turns", "formatted", "loss_spans")
    return formatted(canonical_turns(bare, json_col, mappings))
