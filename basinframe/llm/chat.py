r"""Chat formatting with DataFrame functions only.

*Layouts.* A record's fingerprint is a hash of its sorted nested field paths, of those that any layout knows, over all elements of its lists. It
selects a declarative mapping to canonical turns, an array of (role, text): message lists under two pairs of names, with texts or lists of
parts, lists that mix both, prompt and answer under three pairs of names, instructions with optional input and system text, and preference
pairs, whose rejected answer is a turn of the role ``rejected``. A list beats fields beside it: of a record that has one, the first
of ``messages``, ``conversations`` and ``chosen`` is taken. For records of JSON text the paths are found row by row, so layouts may be
mixed in one column; rows with such lists or fields as typed columns are read as the JSON that they spell; a table of turns is known by its columns.

*Template.* ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for each turn. Inside roles and texts a backslash is put after the first
character of every control string, and of every control string that has backslashes there already, so no
control string is left and one backslash less gives the text back.

*Loss mask.* ``loss_spans`` marks each assistant text as (turn, start, chars): the code points of that turn, counted
from 1 behind its ``<|turn|>``.

Null texts and null roles are empty strings. Turns are ordered by (turn, role, text), null turns last; repeated rows are repeated
turns. Rows with a null conversation id form one conversation. JSON that is malformed, null or of an unknown layout gives null
turns and a null layout, and its format and spans are null: the row stays. A conversation without turns is an empty string. Further columns of a
table of turns, and further fields of records, are ignored. Null elements of a list are empty turns, null parts of a text nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
_TAIL = r"/?s>|/?INST\]|\|"
ESCAPE = rf"([<\[])(\\*(?:{_TAIL}))"
UNESCAPE = rf"([<\[])\\(\\*(?:{_TAIL}))"

#: Role names of public chat layouts, and what they mean here.
ROLES = {
    "human": "user", "user": "user", "prompter": "user", "gpt": ASSISTANT, "assistant": ASSISTANT, "bot": ASSISTANT,
    "model": ASSISTANT, "chatgpt": ASSISTANT, "system": "system", "tool": "tool",
}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """``items`` names a list whose elements have the fields ``roles`` and ``texts``, of which the first that is there counts; a text in ``parts``
    may be a list of objects with that field. Or ``turns`` lists (role, the fields that make its text). Paths in ``optional`` may be absent."""

    name: str
    items: str | None = None
    roles: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    parts: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = frozenset()

    def paths(self) -> set[str]:
        if self.items:
            inner = {f"{self.items}[].{f}" for f in (*self.roles, *self.texts)}
            return {*(inner or {f"{self.items}[]"}), *({f"{self.items}[].{t}[].{self.parts}" for t in self.texts} if self.parts else ())}
        return {f for _, fields in self.turns for f in fields}

    def fingerprints(self) -> list[str]:
        """Of every choice of optional fields."""
        extra = [c for n in range(len(self.optional) + 1) for c in combinations(sorted(self.optional), n)]
        return [fingerprint((self.paths() - self.optional) | set(c)) for c in extra]


def _asked(name: str, ask: str, answer: str) -> Layout:
    turns = (("system", ("system",)), ("user", (ask,)), (ASSISTANT, (answer,)))
    return Layout(name, turns=turns, optional=frozenset({"system"}))


def _listed(items: str, role: str, text: str) -> tuple[Layout, ...]:
    """A list of messages, of messages in parts, and an empty list."""
    plain = Layout(items, items, (role,), (text,), optional=frozenset({f"{items}[].{role}"}))
    return plain, Layout(f"{items}_parts", items, (role,), (text,), "text"), Layout(f"no_{items}", items)


#: Lists of messages, the first of which counts.
_LISTS = ("messages", "conversations", "chosen")
LAYOUTS = (
    *_listed("messages", "role", "content"),
    *_listed("conversations", "from", "value"),
    *_listed("chosen", "role", "content"),
    Layout("mixed_messages", "messages", ("role", "from"), ("content", "value")),
    Layout("mixed_conversations", "conversations", ("role", "from"), ("content", "value")),
    _asked("prompt_response", "prompt", "response"),
    _asked("prompt_completion", "prompt", "completion"),
    _asked("question_answer", "question", "answer"),
    Layout(
        "instruction",
        turns=(("system", ("system",)), ("user", ("instruction", "input")), (ASSISTANT, ("output",))),
        optional=frozenset({"system", "input"}),
    ),
    Layout(
        "preference",
        turns=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("chosen",)), ("rejected", ("rejected",))),
        optional=frozenset({"system"}),
    ),
)
#: The table of turns: its columns in the order (conversation, position, role, text).
TURN_ROWS = ("conv_id", "turn", "role", "text")
_KNOWN = sorted(set().union(*(x.paths() for x in LAYOUTS)))
_OBJECTS = "array<map<string,variant>>"


def _strings(array: Column) -> Column:
    return F.coalesce(F.array_compact(F.array_distinct(F.flatten(F.array_compact(array)))), F.array().cast("array<string>"))


def _elements(record: Column, name: str) -> Column:
    """The objects of a record's list; null if there is no such list."""
    return F.from_json(F.get_json_object(record, f"$.{name}"), _OBJECTS)


def _part_paths(items: Column, name: str, field: str) -> Column:
    """The paths in all elements' lists of parts."""
    keys = F.transform(items, lambda m: F.flatten(F.array_compact(F.transform(F.try_variant_get(m[field], "$", _OBJECTS), lambda p: F.map_keys(p)))))
    return F.transform(_strings(keys), lambda k: F.concat(F.lit(f"{name}[].{field}[]."), k))


def _list_paths(record: Column, name: str) -> Column:
    """The paths in all elements of a list, or the list itself if it is empty; null if there is none."""
    items = _elements(record, name)
    keys = _strings(F.transform(items, lambda m: F.map_keys(m)))
    empty = F.when(F.size(items) == 0, F.array(F.lit(f"{name}[]"))).otherwise(F.array().cast("array<string>"))
    paths = [empty, F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k))]
    for field in sorted({t for x in LAYOUTS if x.items == name and x.parts for t in x.texts}):
        paths.append(_part_paths(items, name, field))
    return F.when(items.isNotNull(), F.concat(*paths))


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of each JSON record; null if it isn't an object."""
    top = F.json_object_keys(record)
    paths = F.coalesce(*[_list_paths(record, name) for name in _LISTS], top)
    known = F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in _KNOWN])))
    return F.when(top.isNotNull(), F.substring(F.sha2(F.array_join(known, "\n"), 256), 1, 16))


def _role(column: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(column)), column, F.lit(""))


def _turns_of(layout: Layout, record: Column) -> Column:
    if layout.items:

        def text_of(value: Column) -> Column:
            plain = F.try_variant_get(value, "$", "string")
            if not layout.parts:
                return plain
            parts = F.transform(F.try_variant_get(value, "$", _OBJECTS), lambda p: F.try_variant_get(p[layout.parts], "$", "string"))
            return F.coalesce(F.array_join(F.array_compact(parts), "\n"), plain)

        def turn_of(m: Column) -> Column:
            nothing = F.lit(None).cast("string")
            role = F.coalesce(nothing, *[F.try_variant_get(m[f], "$", "string") for f in layout.roles])
            text = F.coalesce(nothing, *[text_of(m[f]) for f in layout.texts])
            return F.struct(_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        return F.transform(_elements(record, layout.items), turn_of)
    turns = []
    for role, fields in layout.turns:
        parts = [F.nullif(F.get_json_object(record, f"$.{f}"), F.lit("")) for f in fields]
        text = F.concat_ws("\n", *parts)
        needed = F.lit(True) if not set(fields) <= layout.optional else F.length(text) > 0
        turns.append(F.when(needed, F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.array_compact(F.array(*turns))


def records_to_turns(records: DataFrame, conv_id: str, record: str) -> DataFrame:
    """Records of JSON text to (conv_id, layout, turns)."""
    marked = records.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"))
    marked = marked.withColumn("mark", json_fingerprint(F.col("record")))
    name = turns = F.lit(None)
    for layout in LAYOUTS:
        own = F.col("mark").isin(layout.fingerprints())
        name = F.when(own, F.lit(layout.name)).otherwise(name)
        turns = F.when(own, _turns_of(layout, F.col("record"))).otherwise(turns)
    return marked.select("conv_id", name.alias("layout"), turns.alias("turns"))


def rows_to_turns(rows: DataFrame, columns: tuple[str, str, str, str] = TURN_ROWS) -> DataFrame:
    """A table of turns to (conv_id, layout, turns), in one shuffle."""
    conv, turn, role, text = (F.col(c) for c in columns)
    empty = F.lit("")
    one = F.struct(turn.isNull().alias("last"), turn.alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))
    grouped = rows.select(conv.alias("conv_id"), one.alias("one")).groupBy("conv_id").agg(F.collect_list("one").alias("all"))
    bare = F.transform(F.array_sort("all"), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", F.lit("turn_rows").alias("layout"), bare.alias("turns"))


def to_turns(data: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """Canonical turns of a table of turns, of JSON records or of records as typed columns; the names of the columns decide."""
    if set(TURN_ROWS) <= set(data.columns):
        return rows_to_turns(data)
    if record in data.columns:
        return records_to_turns(data, conv_id, record)
    known = [c for c in data.columns if c in {p.partition("[]")[0] for p in _KNOWN}]
    if not known:
        raise ValueError(f"no layout has these columns: {data.columns}")
    return records_to_turns(data.select(conv_id, F.to_json(F.struct(*known)).alias("record")), conv_id, "record")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) to (conv_id, formatted, loss_spans), null where turns are."""
    safe = F.transform(
        "turns",
        lambda t: F.struct(
            t["role"].alias("plain"), escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")
        ),
    )
    now = turns.select("conv_id", safe.alias("safe"))
    whole = F.transform("safe", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END)))
    spans = F.filter(
        F.transform(
            "safe",
            lambda t, k: F.when(
                t["plain"] == ASSISTANT,
                F.struct(
                    (k + 1).alias("turn"),
                    (F.char_length(t["role"]) + len(TEXT) + 1).alias("start"),
                    F.char_length(t["text"]).alias("chars"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return now.select("conv_id", F.array_join(whole, "").alias("formatted"), spans.alias("loss_spans"))


def _segments(formatted: Column) -> Column:
    """What stands behind each turn mark."""
    parts = F.split(formatted, r"<\|turn\|>")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation spells."""
    return F.transform(
        _segments(formatted),
        lambda s: F.struct(
            unescaped(F.substring_index(s, TEXT, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(s, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    segments = _segments(formatted)
    return F.transform(
        spans, lambda s: unescaped(F.substring(F.element_at(segments, s["turn"]), s["start"], s["chars"]))
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one that speaks in control strings, formatted and read back."""
    probe = '{"messages": [{"role": "user", "content": "%s"}, {"role": "assistant", "content": "%s"}]}'
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(probe % (said, said)).alias("record"))
    both = to_turns(table(spark, sf_dir, "conversations")).unionByName(to_turns(extra))
    read = format_turns(both).select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    spelt = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spelt, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, 23 + length(regexp_replace(role, '([<\[])(\\*(?:/?s>|/?INST\]|\|))', '\1\\\2', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|\|))', '\1\\\2', 'g')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
