"""Chat formatting with a grammar round trip.

Every turn is rendered by a template, parsed again by a deterministic scanner and compared with its
source. A turn that does not come back identical has its control strings escaped and is tried again.
Rendered turns carry all marks, so a conversation's text is its turns' texts one after another, and
its parse is theirs.

Grammar::

    conversation = { turn }
    turn         = "<s>[INST] " text " [/INST]"            a user's
                 | "<s> " text " </s>"                     an assistant's; its text is under the loss mask
                 | "<s>[ROLE] " role " [/ROLE] " text " [/TURN]"    any other's

Inside role and text, ``[\\INST]`` stands for ``[INST]``, ``[\\\\INST]`` for ``[\\INST]``, and so on for all
control strings: one backslash more than the text has.

Rendering and checking happen where a row is read. Then rows go to their conversation's task in order,
which streams them: a conversation of any length needs the memory of one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bagwise.llm.common import table

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]")
_TAIL = "|".join(re.escape(c[1:]) for c in CONTROLS)
#: A control string with any number of backslashes after its first character.
GUARDED = re.compile(rf"([<\[])(\\*)({_TAIL})")
CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
#: Characters of a conversation that are joined at a time, but for a longer turn.
PART_CHARS = 1 << 20
ROWS = 512


def escaped(text: str) -> str:
    return GUARDED.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return GUARDED.sub(lambda m: m[1] + m[2][1:] + m[3] if m[2] else m[0], text)


def template(role: str, text: str) -> str:
    if role == "user":
        return f"<s>[INST] {text} [/INST]"
    if role == "assistant":
        return f"<s> {text} </s>"
    return f"<s>[ROLE] {role} [/ROLE] {text} [/TURN]"


class Broken(ValueError):
    """The text is no sentence of the grammar."""


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text as (role, text, begin, end); begin to end is the turn's raw text.

    One scan over the control strings, without looking back: the next one must be what the grammar
    allows here.
    """
    marks = list(CONTROL.finditer(rendered))
    turns, at, i = [], 0, 0

    def expect(*allowed: str) -> re.Match:
        nonlocal i
        if i >= len(marks) or marks[i][0] not in allowed:
            raise Broken(f"expected one of {allowed}")
        i += 1
        return marks[i - 1]

    def body(begin: int, end: int) -> tuple[int, int]:
        if end - begin < 2 or rendered[begin] != " " or rendered[end - 1] != " ":
            raise Broken("a text stands between spaces")
        return begin + 1, end - 1

    while at < len(rendered):
        start = expect("<s>")
        if start.start() != at:
            raise Broken("text outside a turn")
        kind = expect("[INST]", "[ROLE]", "</s>")
        if kind[0] == "</s>":
            role, (begin, end), at = "assistant", body(start.end(), kind.start()), kind.end()
        else:
            if kind.start() != start.end():
                raise Broken("text before a mark")
            close = expect("[/INST]" if kind[0] == "[INST]" else "[/ROLE]")
            begin, end = body(kind.end(), close.start())
            role, at = "user", close.end()
            if kind[0] == "[ROLE]":
                role = unescaped(rendered[begin:end])
                last = expect("[/TURN]")
                (begin, end), at = body(close.end(), last.start()), last.end()
        turns.append((role, unescaped(rendered[begin:end]), begin, end))
    return turns


def render(role: str, text: str) -> str:
    """Rendered turn whose parse is the source: as it stands if that works, else with escapes."""
    for r, t in ((role, text), (role, escaped(text)), (escaped(role), escaped(text))):
        out = template(r, t)
        try:
            if [turn[:2] for turn in parse(out)] == [(role, text)]:
                return out
        except Broken:
            pass
    raise Broken(f"no rendering of {role!r} comes back")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, rendered``, null role and text as empty; each rendering is checked."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = zip(part.column("role").to_pylist(), part.column("text").to_pylist())
                yield part.append_column("rendered", pa.array([render(r, t) for r, t in rows], pa.string()))

    blank = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blank.schema.fields)
    return blank.mapInArrow(rendered, f"{kinds}, rendered string")


def in_order(formatted: DataFrame) -> DataFrame:
    """Rows of a conversation together and by turn; rows of one turn by role and text."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class Reader:
    """Reads a conversation's joined text and keeps running digests only.

    Where a turn ends is for the grammar to say: turns are joined first, into parts of bounded size, and
    counted as the parser finds them.
    """

    def __init__(self):
        self.turns = self.loss = self.chars = self.size = 0
        self.all, self.masked, self.held = hashlib.sha256(), hashlib.sha256(), []

    def take(self, rendered: str) -> None:
        self.held.append(rendered)
        self.size += len(rendered)
        if self.size > PART_CHARS:
            self.read()

    def read(self) -> None:
        joined = "".join(self.held)
        self.held, self.size = [], 0
        for role, text, _, _ in parse(joined):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode())
        self.chars += len(joined)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered text.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Rows without a
    conversation are one conversation with a null id. Repeated rows are turns of their own.
    """
    kind = formatted.schema["conv_id"].dataType
    id_type = to_arrow_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def close() -> None:
            reader.read()
            done.append((current, reader.turns, reader.all.hexdigest(), reader.loss, reader.masked.hexdigest(), reader.chars))

        for batch in batches:
            for conv, rendered in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist()):
                if reader is None or conv != current:
                    if reader is not None:
                        close()
                    current, reader = conv, Reader()
                reader.take(rendered)
            if len(done) >= 4096:
                yield out()
                done.clear()
        if reader is not None:
            close()
        if done:
            yield out()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return in_order(formatted).select("conv_id", "rendered").mapInArrow(read, schema)


def conversation_texts(formatted: DataFrame, most_chars: int = PART_CHARS) -> DataFrame:
    """The training texts: ``conv_id, part, text, loss_spans``.

    A conversation longer than ``most_chars`` comes in parts, cut between turns. Spans are begins and
    ends, in characters of the part, of the raw assistant texts.
    """
    id_type, kind = to_arrow_type(formatted.schema["conv_id"].dataType), formatted.schema["conv_id"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, part, pieces, spans, size, begun = None, 0, [], [], 0, False

        def out() -> pa.RecordBatch:
            flat = pa.array([spans], pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(
                [pa.array([current], id_type), pa.array([part], pa.int64()), pa.array(["".join(pieces)]), flat],
                ["conv_id", "part", "text", "loss_spans"],
            )

        for batch in batches:
            for conv, rendered in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist()):
                if begun and (conv != current or size + len(rendered) > most_chars):
                    yield out()
                    part = part + 1 if conv == current else 0
                    pieces, spans, size = [], [], 0
                current, begun = conv, True
                spans += [[size + b, size + e] for role, _, b, e in parse(rendered) if role == "assistant"]
                pieces.append(rendered)
                size += len(rendered)
        if begun:
            yield out()

    schema = f"conv_id {kind}, part long, text string, loss_spans array<array<long>>"
    return in_order(formatted).select("conv_id", "rendered").mapInArrow(joined, schema)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts are control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return digest_conversations(format_turns(turns.unionByName(odd)))


#: What must be read back, computed from the table itself; the length counts the template's characters.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])')) AS guards FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + guards + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 9 ELSE 27 + length(role) END)::BIGINT
         AS formatted_chars
FROM m GROUP BY conv_id
"""
