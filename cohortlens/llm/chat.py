"""Operator 9: chat formatting.

A finite-state machine over roles goes through the turns of each conversation
in order, checks the turn order and emits text segments with a loss flag each,
as a declarative ``Template`` says.  Inside texts (and role names) control
strings are escaped with backslashes, so the output can be parsed back.

Rows are sorted by conversation and turn within partitions and streamed
through the machine: its memory is one batch and one state, however long a
conversation is.  Segments are written as Parquet; the digest reads them back.

Defined results: null text is empty, a null role is the empty role; a role the
machine doesn't know makes the turn out of order, is written all the same and
carries no loss.  A conversation is in order if every turn is, it has one, and
it ends in an accepting state.  Rows with the same turn go by role and text;
repeated rows are turns of their own; null turns come first; rows without a
conversation id are one conversation.  Empty tables give empty outputs; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.common import python_workers, stored

ESCAPE = "\\"
CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                              T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


@dataclass(frozen=True)
class Template:
    """How turns look, which texts are learned, and which order is right."""
    head: str = "<|im_start|>"            # then the role and a line end
    tail: str = "<|im_end|>\n"
    learned: frozenset = frozenset({"assistant"})
    controls: tuple = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    moves: dict = field(default_factory=lambda: {       # state -> role -> state
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    accepting: frozenset = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        text = text.replace(ESCAPE, ESCAPE * 2)
        return re.sub("|".join(map(re.escape, self.controls)), lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """Next state, and whether the role may come in ``state``.  After a
        wrong turn the machine goes on from where its role leads."""
        following = self.moves.get(state, {}).get(role)
        if following is not None:
            return following, True
        return next((to[role] for to in self.moves.values() if role in to), state), False

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of a turn: head, text, tail."""
        name = self.escape(role).replace("\n", ESCAPE + "\n")
        return [(f"{self.head}{name}\n", False), (self.escape(text), role in self.learned), (self.tail, False)]

    def role_of(self, head: str) -> str:
        if not (head.startswith(self.head) and head.endswith("\n")):
            raise ValueError(f"not the head of a turn: {head[:40]!r}")
        return self.unescape(head[len(self.head):-1])

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Turns of a formatted conversation: the inverse of formatting."""
        inner = r"((?:[^\\]|\\.)*?)"
        turn = re.compile(re.escape(self.head) + r"((?:[^\\\n]|\\.)*)\n" + inner + re.escape(self.tail), re.DOTALL)
        turns, at = [], 0
        while at < len(formatted):
            found = turn.match(formatted, at)
            if not found:
                raise ValueError(f"no turn at {at}")
            turns.append((self.unescape(found[1]), self.unescape(found[2])))
            at = found.end()
        return turns


TEMPLATE = Template()
SEGMENTS = "conv_id bigint, turn_no bigint, piece int, text string, loss boolean, in_order boolean, state string"
_NEW = object()


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Segments (SEGMENTS) of every conversation, in the order turn_no, piece.
    ``in_order`` and ``state`` are those after the turn."""
    python_workers(conversations.sparkSession, 4096)

    def run(batches):
        conv, state, turn_no = _NEW, template.start, 0
        for batch in batches:
            rows: list = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv is _NEW or conv_id != conv:
                    conv, state, turn_no = conv_id, template.start, 0
                state, right = template.step(state, role)
                for piece, (segment, loss) in enumerate(template.segments(role, text)):
                    rows.append((conv_id, turn_no, piece, segment, loss, right, state))
                turn_no += 1
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["conv_id", "turn_no", "piece", "text", "loss", "in_order", "state"])

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, SEGMENTS))


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, from its segments alone: turns, texts under the loss
    mask and lengths, as streaming digests."""
    python_workers(segments.sparkSession, 4096)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches):
        conv = _NEW
        done: list = []

        def close():
            if conv is not _NEW:
                done.append((conv, turns, all_turns.hexdigest(), loss_chars, learned.hexdigest(), chars,
                             right and state in template.accepting))

        for batch in batches:
            for conv_id, piece, text, loss, ok, now in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "piece", "text", "loss", "in_order", "state"))):
                if conv is _NEW or conv_id != conv:
                    close()
                    conv, turns, loss_chars, chars, right = conv_id, 0, 0, 0, True
                    all_turns, learned = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                right, state = right and ok, now
                if piece == 0:
                    turns += 1
                    all_turns.update(template.role_of(text).encode() + b"\n")
                elif piece == 1:
                    all_turns.update(template.unescape(text).encode() + b"\n")
                if loss:
                    plain = template.unescape(text)
                    loss_chars += len(plain)
                    learned.update(plain.encode())
            columns, done = (list(zip(*done)) if done else [()] * len(names)), []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        close()
        columns = list(zip(*done)) if done else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return (segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "piece")
            .select("conv_id", "piece", "text", "loss", "in_order", "state")
            .mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                             "loss_sha256 string, formatted_chars bigint, in_order boolean"))


def digest(conversations: DataFrame) -> DataFrame:
    """Contract columns of the query, with the added conversation -1."""
    text = "</s>[INST] ok [/INST]"
    added = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], CONVERSATIONS)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").unionByName(added)
    return read_back(stored(format_conversations(rows), "chat-segments"))


#: DuckDB SQL for ``digest``'s rows: lengths by counting what is escaped, the
#: machine as a pattern over the roles' first letters.
ORACLE = r"""
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *,
    length(t) + len(regexp_extract_all(t, '\\'))
      + len(regexp_extract_all(t, '<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS text_chars,
    length(r) + len(regexp_extract_all(r, '\\|\n'))
      + len(regexp_extract_all(r, '<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) AS role_chars,
    CASE r WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + role_chars + 1 + text_chars + 11) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(letter, '' ORDER BY turn NULLS FIRST, r, t), 's?(ua)+') AS in_order
FROM sized GROUP BY conv_id
"""
