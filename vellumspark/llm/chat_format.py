r"""Chat formatting by schema fingerprints. DataFrame functions only.

A record (a VARIANT: parsed JSON or any struct) has nested field paths (``prompt``, ``messages[].role``, ``[].role``).
Each of the declarative ``LAYOUTS`` names the paths that it maps. ``fingerprint`` hashes those of a record's paths that
a layout names; equal to the hash of the layout's own, it selects that layout, the one of most paths first. So further
fields of records and messages (ids, names, metadata) do no harm. The layout's mapping turns the record into canonical
turns, array<struct<role, text>>. ``format_turns`` writes each turn as ``<|im_start|>role\ntext<|im_end|>\n`` and
returns the loss spans of the assistant texts; ``read_turns`` and ``read_loss`` invert it.

Escapes: in texts and roles ``<``, k backslashes and ``|`` get one backslash more, so no control string can occur in
them and the inverse takes one away; in roles backslashes are doubled and line feeds written ``\n``.

Cases: null or missing texts and roles are empty; a record of unknown layout gets a null layout and null turns
(kept, for the caller to see); a list without elements has no paths of its elements and so no layout; input columns
named like an output (layout, turns; formatted, loss) are replaced, all others stay; roles human, gpt, bot and model become user and assistant in chat-log layouts,
other roles stay; no turns: an empty text. Repeated and tied turns keep all rows, ordered by (turn, role, text).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role string, text string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the field paths that it maps, in order; turns: SQL over {v}, the record, that gives the canonical turns."""

    name: str
    paths: tuple[str, ...]
    turns: str


_ROLE = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE {0} END"


def _listed(path: str, role: str, text: str, mapped: bool = False) -> str:
    kind = f"array<struct<{role} string, {text} string>>"
    name = _ROLE.format(f"x.`{role}`") if mapped else f"x.`{role}`"
    return f"transform(try_variant_get({{v}}, '{path}', '{kind}'), x -> named_struct('role', coalesce({name}, ''), 'text', coalesce(x.`{text}`, '')))"


def _get(field: str) -> str:
    return f"coalesce(try_variant_get({{v}}, '$.{field}', 'string'), '')"


def _pair(user: str, assistant: str, system: str | None = None) -> str:
    turns = [("system", system)] * bool(system) + [("user", user), ("assistant", assistant)]
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {t})" for r, t in turns) + ")"


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _listed("$.messages", "role", "content")),
    Layout("bare_messages", ("[].content", "[].role"), _listed("$", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), _listed("$.conversations", "from", "value", True)),
    Layout("prompt_response", ("prompt", "response"), _pair(_get("prompt"), _get("response"))),
    Layout("prompt_completion", ("completion", "prompt"), _pair(_get("prompt"), _get("completion"))),
    Layout("question_answer", ("answer", "question"), _pair(_get("question"), _get("answer"))),
    Layout("instruction", ("instruction", "output"), _pair(_get("instruction"), _get("output"))),
    Layout(
        "instruction_input",
        ("input", "instruction", "output"),
        _pair(f"concat({_get('instruction')}, if({_get('input')} = '', '', concat('\n', {_get('input')})))", _get("output")),
    ),
    Layout("system_prompt", ("prompt", "response", "system"), _pair(_get("prompt"), _get("response"), _get("system"))),
)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def paths(record: str, layouts=LAYOUTS) -> Column:
    """The field paths of a record, sorted: its fields, and the fields of the elements of itself and of the lists that layouts name."""
    v = _quoted(record)
    lists = sorted({p.split("[]")[0] for x in layouts for p in x.paths if "[]" in p})
    parts = [f"coalesce(map_keys(try_variant_get({v}, '$', 'map<string,variant>')), array())"]
    for name in lists:
        inner = f"try_variant_get({v}, '$.{name}' , 'array<map<string,variant>>')" if name else f"try_variant_get({v}, '$', 'array<map<string,variant>>')"
        parts.append(f"transform(flatten(transform(coalesce({inner}, array()), x -> coalesce(map_keys(x), array()))), k -> concat('{name}[].', k))")
    return F.expr(f"array_sort(array_distinct(concat({', '.join(parts)})))")


def fingerprint(found: Column, layout: Layout) -> Column:
    """The hash of those of the found paths that the layout maps."""
    return F.xxhash64(F.array_join(F.array_intersect(F.array(*map(F.lit, layout.paths)), found), "\n"))


def to_turns(records: DataFrame, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """records with ``layout`` (null if unknown) and canonical ``turns``; record: a VARIANT column."""
    keep = [c for c in records.columns if c not in ("layout", "turns") or c == record]
    (found,) = unused([*keep, "layout", "turns"], "_paths")
    df = records.select(*map(_quoted, keep)).withColumn(found, paths(record, layouts))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in sorted(layouts, key=lambda x: len(x.paths)):
        same = fingerprint(F.col(found), x) == F.xxhash64(F.lit("\n".join(x.paths)))
        name, turns = F.when(same, F.lit(x.name)).otherwise(name), F.when(same, F.expr(x.turns.format(v=_quoted(record))).cast(TURNS)).otherwise(turns)
    return df.select(*(_quoted(c) for c in keep if c not in ("layout", "turns")), name.alias("layout"), turns.alias("turns"))


_ESC = r"""regexp_replace({0}, r'<(\\*)\|', r'<$1\\|')"""
_UNESC = r"""regexp_replace({0}, r'<(\\*)\\\|', '<$1|')"""


def escape(x: str) -> str:
    return _ESC.format(x)


def unescape(x: str) -> str:
    return _UNESC.format(x)


def escape_role(x: str) -> str:
    return _ESC.format(rf"replace(replace({x}, r'\', r'\\'), '\n', r'\n')")


def unescape_role(x: str) -> str:
    return rf"array_join(transform(split({_UNESC.format(x)}, r'\\\\'), p -> replace(p, r'\n', '\n')), r'\')"


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss``: array<struct<turn, start, length>>, the place of each assistant text, in code points from its turn's start."""
    t = f"coalesce({_quoted(turns)}, array())"
    (segs,) = unused(df.columns, "_segs")
    df = df.withColumn(segs, F.expr(f"transform({t}, t -> named_struct('role', t.role, 'head', concat('{START}', {escape_role('t.role')}, '\\n'), 'body', {escape('t.text')}))"))
    return df.withColumns({
        "formatted": F.expr(f"array_join(transform({segs}, s -> concat(s.head, s.body, '{END}\\n')), '')"),
        "loss": F.expr(f"filter(transform({segs}, (s, i) -> named_struct('turn', i, 'start', char_length(s.head), 'length', if(s.role = 'assistant', char_length(s.body), -1))), x -> x.length >= 0)"),
    }).drop(segs)


def _segments(formatted: str) -> str:
    return rf"filter(split({formatted}, r'<\|im_end\|>\n'), s -> s <> '')"


def read_turns(formatted: str = "formatted") -> Column:
    """The turns of a formatted text, unescaped."""
    head = len(START) + 1
    return F.expr(
        f"transform({_segments(formatted)}, s -> named_struct('role', {unescape_role(f'''substring(s, {head}, locate('\\n', s) - {head})''')}, 'text', {unescape('''substring(s, locate('\\n', s) + 1)''')}))"
    )


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss spans, unescaped."""
    return F.expr(f"array_join(transform({loss}, x -> {unescape(f'substring(element_at({_segments(formatted)}, x.turn + 1), x.start + 1, x.length)')}), '')")


EXTRA = "SELECT -1L AS conv_id, t.turn, t.role, '<|im_end|><|im_start|>assistant ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def records_of(conversations: DataFrame) -> DataFrame:
    """One record of the messages layout per conversation from rows by turn. The rows of one conversation meet in its row, as the result asks."""
    return (
        conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("m"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
        .select("conv_id", F.to_variant_object(F.struct(F.transform("ms", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))).alias("messages"))).alias("record"))
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) AS role_n,
    length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS text_n FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS body,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + role_n + 1 + text_n + length('<|im_end|>') + 1) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""
