"""Conversations as training text: a finite-state machine over roles and a declarative template.

Turns are brought together by conversation and sorted; one pass over them keeps only the
state of the current conversation, so a conversation of any length takes the memory of one
batch. The machine checks the order of roles. Each turn becomes segments of text with a loss
flag each, in the words of the template. Control strings inside roles and texts are escaped
so that the output can be read back: ``read_back`` does that, from the segments alone.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import rows_of, small_batches

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles that are learned, and the order of roles: state, role, next state.

    Marks begin with ``<|``, which no escaped text holds.
    """

    start: str = "<|im_start|>"
    head_end: str = "\n"
    end: str = "<|im_end|>\n"
    learned: frozenset[str] = frozenset({"assistant"})
    first: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )

    def move(self, state: str, role: str) -> tuple[str, bool]:
        """Next state, and whether the turn is in order; after one that isn't the machine goes on from its role."""
        following = self.moves.get((state, role))
        if following is not None:
            return following, True
        known = {r: s for (_, r), s in self.moves.items()}
        return known.get(role, state), False

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [
            (f"{self.start}{escape_role(role)}{self.head_end}", False), (escape(text), role in self.learned), (self.end, False),
        ]

    def turn(self, output: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        if not (output.startswith(self.start) and output.endswith(self.end)):
            raise ValueError(f"not a turn: {output[:40]!r}")
        role, _, text = output[len(self.start) : len(output) - len(self.end)].partition(self.head_end)
        return unescape_role(role), unescape(text)


def escape(text: str) -> str:
    """``<|`` gets a backslash inside, and one more if it has some."""
    return _PLAIN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


TURN = "conv_id bigint, position bigint, in_order boolean, segments array<struct<text:string,loss:boolean>>"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per turn: conv_id, position in its conversation, in_order, segments (text, loss).

    turns: conv_id, turn, role, text; other columns are not read. Null texts and roles are
    empty; an unknown or empty role is out of order but formatted. Turns are ordered by turn
    (null first); ties and repeated rows by role, then text. A null conv_id is a conversation.
    Rows of a conversation come out together and in order. No rows, no result rows.
    """
    template = template or Template()

    def render(batches):
        current, state, position = None, template.first, 0
        for batch in batches:
            columns = [[], [], [], []]
            for conv, role, text in rows_of([batch], "conv_id", "role", "text"):
                if current != (conv,):
                    current, state, position = (conv,), template.first, 0
                state, in_order = template.move(state, role)
                segments = [{"text": t, "loss": learned} for t, learned in template.segments(role, text)]
                for column, value in zip(columns, (conv, position, in_order, segments), strict=True):
                    column.append(value)
                position += 1
            kinds = (pa.int64(), pa.int64(), pa.bool_(), _SEGMENTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "position", "in_order", "segments"]
            )

    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return small_batches(placed).mapInArrow(render, TURN)


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per conversation of format_chats()'s rows, read from the segments: conv_id, n_turns, turns_sha256
    (role and text of each turn, each followed by a line end), loss_chars and loss_sha256 (unescaped text under
    the loss flag), formatted_chars, and in_order (all turns are)."""
    template = template or Template()
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("in_order", pa.bool_())]
    )

    def read(batches):
        current, done = None, []

        def close():
            if current is not None:
                conv, n, turns, chars, loss, total, fine = current
                done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, fine))

        def ready():
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in done], kind) for i, kind in enumerate(schema.types)], schema=schema
            )
            done.clear()
            return out

        for batch in batches:
            for conv, in_order, segments in rows_of([batch], "conv_id", "in_order", "segments"):
                if current is None or current[0] != conv:
                    close()
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                role, text = template.turn("".join(s["text"] for s in segments))
                learned = unescape("".join(s["text"] for s in segments if s["loss"]))
                current[1] += 1
                current[2].update(f"{role}\n{text}\n".encode())
                current[3] += len(learned)
                current[4].update(learned.encode())
                current[5] += sum(len(s["text"]) for s in segments)
                current[6] &= in_order
            yield ready()
        close()
        yield ready()

    kinds = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, in_order boolean"
    return formatted.mapInArrow(read, kinds)


# The conversation whose texts hold the template's own marks.
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"
PROBE = ((-1, 0, "user", PROBE_TEXT), (-1, 1, "assistant", PROBE_TEXT))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations' rows and the probe's."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame(list(PROBE), "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}')),
steps AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|'))
    + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS in_order
FROM steps GROUP BY conv_id
"""
