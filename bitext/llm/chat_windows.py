"""Chat formatting in budgeted windows (operator 7).

Turns are formatted as ``<s>[INST]role[/INST]text</s>``.  A control string
inside a role or text gets a backslash after its first character, and a
backslash is doubled, so the formatted text is read back without loss.

A conversation is cut into windows of whole turns.  Running token sums choose
each window's turns: the system turn (when the conversation starts with one),
then the latest earlier turns of at most ``history`` tokens, repeated for
context, then new turns while the window stays within ``budget`` tokens (one
new turn at least; a longer turn stands in a window beyond the budget, never
cut).  The loss mask covers the assistant texts among the new turns, so every
assistant text counts once over all windows.

Conversations are streamed in turn order: a task holds the system turn, the
history and one window, whatever a conversation's length.

Cases: null text and role are empty; a null conv_id is a conversation; turns
with equal numbers are ordered by role and text, repeated rows stay; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

BUDGET, HISTORY = 512, 128
#: The template's control strings.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(BEGIN + OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.S)
#: Tokens of a turn: words and single marks of its text, and its four marks.
TOKENS = r"4 + coalesce(regexp_count(text, '\\w+|[^\\w\\s]'), 0)"

WINDOW = ("conv_id long, window long, first_turn long, n_repeated long, n_tokens long, formatted string, "
          "loss array<struct<start: long, end: long>>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, place of the text) of each formatted turn."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2)) for m in _TURN.finditer(formatted)]


class _Cutter:
    """Windows of one conversation, turn by turn; a turn is (role, text, tokens)."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.past, self.new, self.window, self.first = None, [], [], 0, 0

    def _lead(self) -> list:
        return [self.system] if self.system and self.window else []

    def _tokens(self) -> int:
        return sum(t[2] for t in (*self._lead(), *self.past, *self.new))

    def add(self, turn):
        """Takes a turn; returns the window that it does not fit in, or None."""
        done = None
        if not self.window and not self.new and turn[0] == "system":
            self.system = turn
        if self.new and self._tokens() + turn[2] > self.budget:
            done = self.close()
        if not self.new:
            while self.past and self._tokens() + turn[2] > self.budget:
                self.past.pop(0)
        self.new.append(turn)
        return done

    def close(self):
        """The window in hand; the next one starts with its latest turns."""
        before = [*self._lead(), *self.past]
        out, loss, at = [], [], 0
        for i, (role, text, _) in enumerate([*before, *self.new]):
            head, body = BEGIN + OPEN + escape(role) + CLOSE, escape(text)
            if i >= len(before) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            out.append(head + body + END)
            at += len(out[-1])
        row = self.conv, self.window, self.first, len(before), self._tokens(), "".join(out), loss
        kept, total = [], 0
        for t in reversed([*self.past, *self.new]):
            if t is self.system or total + t[2] > self.history:
                break
            kept.insert(0, t)
            total += t[2]
        self.first += len(self.new)
        self.past, self.new, self.window = kept, [], self.window + 1
        return row


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_repeated", pa.int64()),
                     ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss", _SPANS)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut(budget: int, history: int):
    def run(batches):
        cutter = None
        for batch in batches:
            found = []
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n_tokens"))):
                if cutter is None or conv != cutter.conv:
                    if cutter:
                        found.append(cutter.close())
                    cutter = _Cutter(conv, budget, history)
                if done := cutter.add(tuple(turn)):
                    found.append(done)
            yield _batch(found, _WINDOW)
        if cutter:
            yield _batch([cutter.close()], _WINDOW)
    return run


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows: conv_id, window, first_turn (ordinal of its first new
    turn), n_repeated (turns before the new ones), n_tokens, formatted, loss
    (character spans of ``formatted``)."""
    if history >= budget:
        raise ValueError("history must be smaller than budget")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("n_tokens", F.expr(TOKENS).cast("long"))
    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_cut(budget, history), WINDOW))


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Reader:
    """Digests of one conversation, window by window."""

    def __init__(self, conv):
        self.conv, self.n_turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, repeated: int, formatted: str, loss: list[dict]):
        for role, text, _ in read_turns(formatted)[repeated:]:
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"]: span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches):
    reader = None
    for batch in batches:
        out = []
        for conv, *window in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_repeated", "formatted", "loss"))):
            if reader is None or conv != reader.conv:
                if reader:
                    out.append(reader.row())
                reader = _Reader(conv)
            reader.add(*window)
        yield _batch(out, _DIGEST)
    if reader:
        yield _batch([reader.row()], _DIGEST)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, from formatted windows alone."""
    return (windows.select("conv_id", "window", "n_repeated", "formatted", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "window")
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long"))


@query("op7_chat_windows")
def op7(spark, sf_dir: str) -> DataFrame:
    """Contract: all conversations and one more, -1, of control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(chat_windows(turns.unionByName(more)))
