"""Chat formatting by schema fingerprints.

A record is a nested value in one of many layouts. The set of its field paths, names without
types, is hashed; the hash selects a declarative mapping that says where turns, roles and texts
are. Canonical turns are laid out with a template that marks turns and escapes its own control
strings inside texts, so that the output can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepline.llm.quality import bind

TURN = "struct<role:string,text:string>"
LARGE = 16_000_000  # bytes of a record from which it is read without a variant


@dataclass(frozen=True)
class Mapping:
    """How records of one layout become turns.

    example is a JSON record with every field of the layout. A layout either has a list of
    turns at ``turns`` with the fields ``role`` and ``text`` (roles renamed by ``roles``), or
    single fields, each with the role of its turn, in ``fields``; ``optional`` ones give no turn
    when they are empty.
    """

    name: str
    example: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()


MAPPINGS = (
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', turns="messages"),
    Mapping("conversations", '{"conversations": [{"from": "", "value": ""}]}', turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt", '{"prompt": "", "completion": ""}', fields=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question", '{"data": {"question": "", "answer": ""}}', fields=(("data.question", "user"), ("data.answer", "assistant"))),
    Mapping("instruction", '{"system": "", "instruction": "", "output": ""}', fields=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
    Mapping("instruction_input", '{"instruction": "", "input": "", "output": ""}', fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("input",)),
)


@dataclass(frozen=True)
class Template:
    """Marks around a turn, the escape sign, and foreign control strings that are escaped as well."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    escape: str = "\\"
    # Control strings of widely used chat formats.
    foreign: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learn: str = "assistant"  # the role whose texts are under the loss mask

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.foreign)


def paths(record: Column) -> Column:
    """The field paths of a variant as text: its schema with all types left out."""
    bare = F.regexp_replace(F.schema_of_variant(record), r"(?<=[:<] ?)(?:STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\(\d+,\s?\d+\)|DATE|TIMESTAMP(?:_NTZ)?|FLOAT|BINARY|VARIANT|UUID)(?=[,>]|$)", "_")
    return F.regexp_replace(bare, r"ARRAY<_>", "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths(record))


def skeleton(json: Column) -> Column:
    """The record with empty strings for values and equal neighbours in a list taken as one.

    It has the field paths of the record and is small enough for a variant. Escapes become one
    sign, so that a name with an escape is no known name.
    """
    plain = F.regexp_replace(json, r"\\.", "\ue000")
    names = F.regexp_replace(plain, r'"(?:([^"]*+)"\s*+(:)|[^"]*+")', r'"$1"$2')
    return F.regexp_replace(F.regexp_replace(names, r"\s++", ""), r"(\{[^{}\[\]]*+\},)\1++", "$1")


def _typed(m: Mapping) -> str:
    """The type of the layout's records, texts as strings."""
    if m.turns is not None:
        return f"struct<{m.turns}:array<struct<{m.role}:string,{m.text}:string>>>"
    tree: dict = {}
    for path, _ in m.fields:
        at = tree
        for name in path.split("."):
            at = at.setdefault(name, {})
    kind = lambda t: "struct<" + ",".join(f"{k}:{kind(v)}" for k, v in t.items()) + ">" if t else "string"
    return kind(tree)


def _turns(m: Mapping, record: Column, typed: bool = False) -> Column:
    """The turns of a variant, or of a value of the layout's own type."""

    def get(path: str, kind: str) -> Column:
        if not typed:
            return F.try_variant_get(record, f"$.{path}", kind)
        value = record
        for name in path.split("."):
            value = value[name]
        return value

    if m.turns is None:
        turns = [F.struct(F.lit(role).alias("role"), F.coalesce(get(path, "string"), F.lit("")).alias("text")) for path, role in m.fields]
        if not m.optional:
            return F.array(*turns)
        keep = [(path not in m.optional) for path, _ in m.fields]
        marked = F.array(*[F.struct(t.alias("t"), F.lit(k).alias("k")) for t, k in zip(turns, keep, strict=True)])
        return F.transform(F.filter(marked, lambda x: x["k"] | (F.length(x["t"]["text"]) > 0)), lambda x: x["t"])
    named = get(m.turns, f"array<struct<{m.role}:string,{m.text}:string>>")
    renamed = F.create_map(*[F.lit(x) for pair in m.roles for x in pair]) if m.roles else None

    def canonical(t: Column) -> Column:
        role = F.coalesce(t[m.role], F.lit(""))
        return F.struct((F.coalesce(F.try_element_at(renamed, role), role) if renamed is not None else role).alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text"))

    return F.transform(named, canonical)


def canonical_turns(records: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, out: str = "turns") -> DataFrame:
    """records with an array of (role, text) turns and, in ``<out>_layout``, the mapping's name.

    Paths decide, not types: null and number fields fit like strings, and null roles and texts
    become empty. A record with a further or a missing field, an unparsable one, a null and
    an empty list of turns have no layout; their turns are null and the caller decides. A
    variant holds no string above 20,000,000 characters and 128 MiB in all: longer records are
    told by the variant of their skeleton and read with the type of their layout.
    """
    one = records.sparkSession.range(1)
    known = one.select(*[fingerprint(F.parse_json(F.lit(m.example))).alias(m.name) for m in mappings]).first()
    parsed = records.withColumn("__v", F.when(F.octet_length(json_col) <= LARGE, F.try_parse_json(json_col))).withColumn("__fp", fingerprint(F.col("__v")))
    parsed = parsed.withColumn("__fl", F.when(F.octet_length(json_col) > LARGE, fingerprint(F.try_parse_json(skeleton(F.col(json_col))))))
    turns, layout = F.when(F.lit(False), F.lit(None).cast(f"array<{TURN}>")), F.when(F.lit(False), F.lit(""))
    for m in mappings:
        here = F.col("__v").isNotNull() & (F.col("__fp") == known[m.name])
        turns, layout = turns.when(here, _turns(m, F.col("__v"))), layout.when(here, F.lit(m.name))
        large = F.col("__fl") == known[m.name]
        turns, layout = turns.when(large, _turns(m, F.from_json(F.col(json_col), _typed(m), {"maxStringLen": str(2**31 - 1)}), typed=True)), layout.when(large, F.lit(m.name))
    return parsed.withColumn(out, turns).withColumn(f"{out}_layout", layout).drop("__v", "__fp", "__fl")


def escaped(text: Column, template: Template = Template()) -> Column:
    """Escape signs are doubled; inside a control string one is put after its first character."""
    e = template.escape
    out = F.replace(text, F.lit(e), F.lit(e + e))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + e + c[1:]))
    return out


def unescaped(text: Column, template: Template = Template()) -> Column:
    e = "\\" + template.escape
    return F.regexp_replace(text, f"{e}({e}?)", "$1")


def formatted(turns: Column, template: Template = Template()) -> Column:
    """A struct of the laid-out text and the spans under the loss mask, as (from, length) in characters."""
    parts = F.transform(turns, lambda t: F.struct(F.concat(F.lit(template.start), escaped(t["role"], template), F.lit(template.middle)).alias("head"), escaped(t["text"], template).alias("body"), (t["role"] == template.learn).alias("learn")))

    def lay(p: Column) -> Column:
        text = F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(template.end))), "")
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,length:int>>").alias("spans"))

        def walk(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["head"])
            size = F.length(x["body"])
            span = F.struct(start.alias("from"), size.alias("length"))
            return F.struct((start + size + len(template.end)).alias("at"), F.when(x["learn"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

        return F.struct(text.alias("text"), F.aggregate(p, zero, walk)["spans"].alias("loss"))

    return bind(parts, lay)


def read_back(text: Column, template: Template = Template()) -> Column:
    """The turns of a laid-out text, unescaped."""
    pieces = F.split(text, "\\Q" + template.end + "\\E")
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(template.start) + 1), F.length(p))
        halves = F.split(body, "\\Q" + template.middle + "\\E", 2)
        return F.struct(unescaped(F.get(halves, 0), template).alias("role"), unescaped(F.get(halves, 1), template).alias("text"))

    return F.transform(whole, turn)


def loss_text(text: Column, loss: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["from"] + 1, s["length"]), template)), "")


def records_of(turn_rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, record): the conversation of each id as one JSON record, in the layout its shape suggests.

    Two turns of user and assistant are a prompt with its completion, a system turn before them
    an instruction; others are lists of messages, in one of two spellings by their number of
    turns. Turns of equal number are ordered by role and text; a null text is empty.
    """
    turn = F.struct(F.col(turn_col).alias("at"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    convs = turn_rows.groupBy(F.col(conv_col).alias("conv")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")
    text = [F.get("t", k)["text"] for k in range(3)]
    prompt = F.to_json(F.struct(text[0].alias("prompt"), text[1].alias("completion")))
    instruction = F.to_json(F.struct(text[0].alias("system"), text[1].alias("instruction"), text[2].alias("output")))
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    spoken = F.transform("t", lambda x: F.struct(F.coalesce(F.try_element_at(names, x["role"]), x["role"]).alias("from"), x["text"].alias("value")))
    plain = ~F.exists("t", lambda x: x["role"].isin("human", "gpt"))
    record = F.when(roles == "user,assistant", prompt).when(roles == "system,user,assistant", instruction)
    record = record.when(plain & (F.size("t") % 2 == 1), F.to_json(F.struct(spoken.alias("conversations")))).otherwise(messages)
    return convs.select("conv", record.alias("record"))


def format_records(records: DataFrame, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, template: Template = Template()) -> DataFrame:
    """records with ``turns_layout``, ``formatted`` and ``loss`` (spans); null where no mapping fits."""
    turned = canonical_turns(records, json_col, mappings)
    laid = turned.withColumn("__f", formatted(F.col("turns"), template))
    return laid.withColumn("formatted", F.col("__f.text")).withColumn("loss", F.col("__f.loss")).drop("__f", "turns")
