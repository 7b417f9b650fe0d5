"""Operator 6, chat formatting by schema fingerprint.

A record's layout is known by a fingerprint: the hash of its nested field paths.
The fingerprint selects a declarative mapping that says where turns, roles and texts
lie; the mapping yields canonical turns, and a template writes them. Control strings
inside texts are escaped reversibly, and spans of assistant text make the loss mask.
Everything is built-in expressions; a record is a Variant, so one column can hold
layouts of any kind.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and texts every
``<``, run of backslashes, ``|`` gets one more backslash, so no control string can stand in them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import running_sums

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``example``: a JSON record of the layout; its field paths give the fingerprint.
    ``turns``: for flat layouts, (role or path of the role, path of the text) in order; a
    role that starts with ``$`` is a path. A turn with a null text is left out if
    ``optional``.
    ``each``: for message layouts, (path of the array, field of the role, field of the text).
    ``rename``: whether ROLE_NAMES apply; the canonical layout's roles stay as they are.
    """

    name: str
    example: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: bool = True
    rename: bool = True


#: Roles that other layouts use for the canonical ones.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = (
    Mapping("turn", '{"role": "", "text": ""}', turns=(("$.role", "$.text"),), optional=False, rename=False),
    Mapping("prompt", '{"prompt": "", "completion": ""}', turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", '{"prompt": "", "response": ""}', turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question", '{"question": "", "answer": ""}', turns=(("user", "$.question"), ("assistant", "$.answer"))),
    Mapping("instruction", '{"instruction": "", "output": ""}', turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input", '{"instruction": "", "input": "", "output": ""}', turns=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', each=("$.messages", "role", "content")),
    Mapping("conversations", '{"conversations": [{"from": "", "value": ""}]}', each=("$.conversations", "from", "value")),
    Mapping("system_messages", '{"system": "", "messages": [{"role": "", "content": ""}]}', turns=(("system", "$.system"),), each=("$.messages", "role", "content")),
)


def fingerprint(record: Column) -> Column:
    """XXH64 of the nested field paths of a Variant, whatever the types of their values."""
    # Types are upper-case words after a colon or a bracket; what stays spells the paths.
    paths = F.regexp_replace(F.schema_of_variant(record), r"(?<=: |<)(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP(_NTZ)?|BINARY|UUID|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>])", "?")
    return F.xxhash64(paths)


def layout_fingerprint(example: str) -> int:
    """The fingerprint of a JSON example, as ``fingerprint`` gives it for a record."""

    def paths(x) -> str:
        if isinstance(x, dict):
            return f"OBJECT<{', '.join(f'{k}: {paths(x[k])}' for k in sorted(x))}>"
        return f"ARRAY<{paths(x[0])}>" if isinstance(x, list) else "?"

    value = xxhash.xxh64_intdigest(paths(json.loads(example)), 42)
    return value - (value >> 63 << 64)


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _turn(role: Column, text: Column, rename: bool) -> Column:
    if rename:
        role = F.coalesce(F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])[role], role)
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(record: Column, m: Mapping) -> Column:
    flat = [(F.lit(r) if not r.startswith("$") else _text(record, r), _text(record, t)) for r, t in m.turns]
    out = F.array(*[_turn(r, t, m.rename) for r, t in flat]) if not m.optional else F.filter(F.array(*[F.when(t.isNotNull(), _turn(r, t, m.rename)) for r, t in flat]), lambda x: x.isNotNull())
    if m.each:
        path, role, text = m.each
        items = F.try_variant_get(record, path, "array<variant>")
        listed = F.transform(F.coalesce(items, F.expr("cast(array() as array<variant>)")), lambda x: _turn(_text(x, f"$.{role}"), _text(x, f"$.{text}"), m.rename))
        out = F.concat(out, listed) if m.turns else listed
    return out


def canonical_turns(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """array<struct<role, text>> of a Variant record; null if no mapping has its fingerprint.

    Null roles and texts are empty. Message arrays that are empty have other paths than
    full ones and so have no mapping.
    """
    found = fingerprint(record)
    out = None
    for m in mappings:
        hit = found == layout_fingerprint(m.example)
        out = F.when(hit, _mapped(record, m)) if out is None else out.when(hit, _mapped(record, m))
    return out


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _role(c: Column) -> Column:
    """A role on one line: backslashes and line ends are written as two characters."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unrole(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")


def write_turn(turn: Column) -> Column:
    """A canonical turn in the template."""
    return F.concat(F.lit(START), escape(_role(turn["role"])), F.lit("\n"), escape(turn["text"]), F.lit(END))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn",), turn_col: str = "canonical") -> DataFrame:
    """(conv, formatted, loss_spans): one row per conversation.

    ``turns`` holds rows with an array of canonical turns each; a conversation's rows are
    put in the order of ``order``, equal ones by their turns. ``loss_spans`` lists (turn,
    start, end) of each text under the loss mask, in code points of ``formatted``, end
    exclusive. A conversation is one training sample and lies in one row, as does its
    digest; what a task holds grows with the longest conversation, not with their number.
    Rows without a mapping (null turns) give no turn. A null conversation id is a group.
    """
    one = turns.select(F.col(conv_col), F.struct(*[F.col(c) for c in order], F.col(turn_col).alias("_t")).alias("_row"))
    whole = one.groupBy(conv_col).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    flat = F.flatten(F.filter(F.transform("_rows", lambda r: r["_t"]), lambda x: x.isNotNull()))
    pieces = whole.select(conv_col, F.transform(flat, lambda t: F.struct(t["role"].alias("role"), write_turn(t).alias("piece"))).alias("_p"))
    # The end of each piece, then the spans of the turns under the mask.
    ends = running_sums(F.transform("_p", lambda p: F.length(p["piece"]).cast("long")))

    def span(end: Column, k: Column) -> Column:
        p = F.get("_p", k)
        return F.struct(k.alias("turn"), (end - F.length(p["piece"]) + len(START) + F.length(p["role"]) + 1).alias("start"), (end - len(END)).alias("end"))

    marked = F.filter(F.transform(ends, span), lambda s: F.get("_p", s["turn"])["role"].isin(*LOSS_ROLES))
    return pieces.select(conv_col, F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("formatted"), marked.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text, chars>> of a formatted conversation; chars: of the escaped text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(START) + 1), F.length(part))
        cut = F.locate("\n", body)
        text = F.substring(body, cut + 1, F.length(body))
        return F.struct(_unrole(unescape(F.substring(body, F.lit(1), cut - 1))).alias("role"), unescape(text).alias("text"), F.length(text).alias("chars"))

    return F.transform(parts, turn)


def digest(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and hashes of what the formatted text gives when read back."""
    got = formatted.select(conv_col, "formatted", "loss_spans", read_back(F.col("formatted")).alias("_turns"))
    # The text under the mask; a span that isn't exactly a turn's text is an error.
    under = F.expr("transform(loss_spans, s -> if(get(_turns, s.turn).chars = s.end - s.start, get(_turns, s.turn).text, raise_error('the loss mask does not fit')))")
    lost = got.withColumn("_loss", F.array_join(under, ""))
    spoken = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return lost.select(
        conv_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def rows_as_records(df: DataFrame, role_col: str = "role", text_col: str = "text") -> Column:
    """A typed row of role and text as a Variant record."""
    return F.to_variant_object(F.struct(df[role_col].cast("string").alias("role"), df[text_col].cast("string").alias("text")))
