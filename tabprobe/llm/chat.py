"""Chat formatting: budgeted, turn-aligned windows with a loss mask.

A conversation's turns stream through one task in order; only the system turn, the current
window and the limited history are held, so memory is bounded by the budget (or the longest
turn), not by the conversation. Windows are chosen from running token sums.

Template: each turn is ``### <Role>: <text></turn>\\n``. Inside texts, ``\\`` becomes ``\\\\`` and a
backslash goes before every ``### `` and ``</turn>``; unescaping drops one level, so any text, one
that quotes the template included, is read back as it was.
"""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.text import whole

END = "</turn>"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
TURN = re.compile(r"(?s)### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n")
# A turn's own marks count as so many tokens.
TURN_TOKENS = 4
# Words and single marks: an estimate of tokens that needs no vocabulary.
TOKEN_PATTERN = r"\w+|[^\w\s]"
WINDOW_SCHEMA = "window bigint, formatted string, loss array<struct<start:int,stop:int>>, n_repeated int, n_turns int, n_tokens bigint"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("### ", "\\### ").replace(END, "\\" + END)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render_role(role: str) -> str:
    return ROLES.get(role) or "@" + role.replace("\\", "\\\\").replace(":", "\\:")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn; start and stop bound the escaped text."""
    out = []
    for m in TURN.finditer(formatted):
        name = m[1]
        role = unescape(name[1:]) if name.startswith("@") else NAMES[name]
        out.append((role, unescape(m[2]), m.start(2), m.end(2)))
    return out


class Windows:
    """Streams one conversation's turns into windows."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.tail, self.tail_sum = None, deque(), 0
        self.seen = self.number = 0
        self._open()

    def _open(self) -> None:
        """Begin a window: the system turn and as much of the history as its limit allows."""
        self.repeated = ([self.system] if self.system and self.seen else []) + list(self.tail)
        self.repeated_sum = sum(t[2] for t in self.repeated)
        self.span, self.span_sum = [], 0

    def add(self, role: str, text: str, tokens: int):
        """Take the next turn; yields a window that it closes."""
        if self.span and self.repeated_sum + self.span_sum + tokens > self.budget:
            yield self.close()
            self._open()
        if not self.span and self.repeated_sum + tokens > self.budget:
            # A turn that does not fit beside the history goes without it.
            self.repeated = [self.system] if self.system and self.seen else []
            self.repeated_sum = sum(t[2] for t in self.repeated)
        turn = (role, text, tokens)
        self.span.append(turn)
        self.span_sum += tokens
        if not self.seen and role == "system":
            self.system = turn
        else:
            self.tail.append(turn)
            self.tail_sum += tokens
            while self.tail and self.tail_sum > self.history:
                self.tail_sum -= self.tail.popleft()[2]
        self.seen += 1

    def close(self) -> tuple:
        parts, spans, at = [], [], 0
        for k, (role, text, _) in enumerate([*self.repeated, *self.span]):
            head, body = f"### {render_role(role)}: ", escape(text)
            if role == "assistant" and k >= len(self.repeated):
                spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
            parts += [head, body, END, "\n"]
            at += len(head) + len(body) + len(END) + 1
        self.number += 1
        return (self.number - 1, "".join(parts), spans, len(self.repeated), len(self.span), self.repeated_sum + self.span_sum)


def _by_key(batches, names):
    """(key, row) of each row, over all batches."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batches(rows, schema, chars):
    """Record batches of about 2 M characters; ``chars`` counts a row's."""
    import pyarrow as pa

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += chars(row)
        if size >= 2 << 20 or len(part) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def format_chats(turns: DataFrame, budget: int = 1024, history: int = 256, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows of at most ``budget`` tokens, cut between turns.

    A window holds the conversation's system turn (if its first turn is one), up to ``history``
    tokens of turns just before, repeated without loss, then new turns. A turn over the budget
    gets a window without history. ``loss`` spans (in code points of ``formatted``) cover each
    assistant text exactly once over all windows.

    Returns id_col, ``window`` (from 0), ``formatted``, ``loss``, ``n_repeated`` and ``n_turns`` (repeated
    and new turns), ``n_tokens``. Null roles and texts are empty; null ids form one conversation;
    null turns come first; equal turns are ordered by role and text, and repeated rows are turns of
    their own. An empty table gives an empty table.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    text = whole(F.col(text_col))
    base = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), whole(F.col(role_col)).alias("role"), text.alias("text"),
                        (F.regexp_count(text, F.lit(TOKEN_PATTERN)) + TURN_TOKENS).alias("tokens"))
    ordered = base.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    schema = f"id {base.schema['id'].dataType.simpleString()}, {WINDOW_SCHEMA}"
    frame = turns.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        def windows():
            now, open_ = None, None
            for key, role, body, tokens in _by_key(batches, ["id", "role", "text", "tokens"]):
                if open_ is None or key != now:
                    if open_ is not None:
                        yield (now, *open_.close())
                    now, open_ = key, Windows(budget, history)
                for w in open_.add(role, body, tokens):
                    yield (now, *w)
            if open_ is not None:
                yield (now, *open_.close())

        yield from _batches(windows(), arrow, lambda row: len(row[2]))

    arrow: pa.Schema = to_arrow_schema(frame)
    return ordered.mapInArrow(run, frame).withColumnRenamed("id", id_col)


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the windows of each conversation hold, parsed from the formatted text and loss spans:
    id_col, ``n_turns``, ``turns_sha256`` (role, newline, text, newline of each turn once, in order),
    ``loss_chars``, ``loss_sha256`` (all text under the mask, unescaped), ``formatted_chars``."""
    import hashlib

    base = windows.select(F.col(id_col).alias("id"), "window", "formatted", "loss", "n_repeated")
    ordered = base.repartition("id").sortWithinPartitions("id", "window")
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = base.schema["id"].dataType.simpleString()
    frame = windows.sparkSession.createDataFrame(
        [], f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").schema
    arrow = to_arrow_schema(frame)

    def run(batches):
        def sums():
            now, s = None, None
            for key, formatted, loss, n_repeated in _by_key(batches, ["id", "formatted", "loss", "n_repeated"]):
                if s is None or key != now:
                    if s is not None:
                        yield (now, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])
                    now, s = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted)[n_repeated:]:
                    s[0] += 1
                    s[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"]:span["stop"]])
                    s[2] += len(text)
                    s[3].update(text.encode())
                s[4] += len(formatted)
            if s is not None:
                yield (now, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])

        yield from _batches(sums(), arrow, lambda row: 200)

    return ordered.mapInArrow(run, frame).withColumnRenamed("id", id_col)
