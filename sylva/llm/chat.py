"""Chat formatting in budgeted windows.

Turns become lines ``<s>[INST] role [/INST] text </s>``; a backslash goes before each control string (and
backslash) in a role or text, so reading back is exact. A turn's tokens are those of its whole line with marks and
escapes; the tokenizer never joins across the line end that ends it, so the tokens of a window are the sum of its
turns'. Prefix sums of them choose windows of whole turns within BUDGET: each opens with the system turn (a first
turn of role system), then repeats the last turns before it that HISTORY allows, then has new turns, one at least.
Loss spans cover the texts of new assistant turns only; what is repeated is masked.

Rows are streamed in order of (conv_id, turn, role, text), so a conversation of any length needs the
memory of one window. Edge cases: null roles and texts are empty; rows that repeat are turns each; null conv_ids are
one conversation; a turn that fits into no window with the system turn is a window's only new one, without history; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .packing import Encoder

BUDGET, HISTORY = 1024, 256
_CONTROL = r"</?s>|\[/?INST\]"
_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_UNESCAPE = re.compile(rf"\\(\\|{_CONTROL})")
_SCAN = re.compile(rf"\\(?:\\|{_CONTROL})|({_CONTROL})")

_TAIL = " </s>\n"

_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()), ("repeated", pa.int32()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts (unescaped) of a formatted window."""
    marks = [(m.start(), m.end()) for m in _SCAN.finditer(text) if m[1]]
    turns = []
    for k in range(0, len(marks), 4):
        (_, _), (_, a), (b, c), (d, _) = marks[k : k + 4]
        turns.append((unescape(text[a + 1 : b - 1]), unescape(text[c + 1 : d - 1])))
    return turns


def line(role: str, text: str) -> tuple[str, int]:
    """The line of a turn, and where its text begins."""
    head = f"<s>[INST] {escape(role)} [/INST] "
    return f"{head}{escape(text)} </s>\n", len(head)


class _Conversation:
    """State of the conversation that is being read: turns that may still be used, with prefix sums of their tokens.

    ``upto[k]`` is the sum of all tokens before turn k of those kept; the first ``fresh`` of them were in a window.
    """

    def __init__(self, conv_id: int | None):
        self.conv_id, self.window = conv_id, 0
        self.system: tuple | None = None
        self.turns: list[tuple[str, str, int]] = []  # role, line, where its text begins
        self.upto = [0]
        self.fresh = 0

    def _first(self) -> int:
        """The first turn that the window repeats, as history and the first new turn allow."""
        lead = self.system[1] if self.system else 0
        room = min(HISTORY, BUDGET - lead - (self.upto[self.fresh + 1] - self.upto[self.fresh]))
        return bisect_left(self.upto, self.upto[self.fresh] - max(0, room), 0, self.fresh)

    def add(self, role: str, text: str, count) -> dict | None:
        """A window, if this turn doesn't fit in it any more."""
        made, begin = line(role, text)
        tokens, out = count(made), None
        if len(self.turns) > self.fresh:
            lead = self.system[1] if self.system else 0
            if lead + self.upto[-1] - self.upto[self._first()] + tokens > BUDGET:
                out = self.flush()
        self.turns.append((role, made, begin))
        self.upto.append(self.upto[-1] + tokens)
        return out

    def flush(self) -> dict | None:
        if len(self.turns) == self.fresh:
            return None
        first = self._first()
        shown = [*([self.system[0]] if self.system else []), *self.turns[first:]]
        repeated = len(shown) - (len(self.turns) - self.fresh)
        loss, at = [], 0
        for k, (role, made, begin) in enumerate(shown):
            if k >= repeated and role == "assistant":
                loss.append({"start": at + begin, "end": at + len(made) - len(_TAIL)})
            at += len(made)
        tokens = (self.system[1] if self.system else 0) + self.upto[-1] - self.upto[first]
        out = {"conv_id": self.conv_id, "window": self.window, "text": "".join(t[1] for t in shown), "n_turns": len(shown), "repeated": repeated, "n_tokens": tokens, "loss": loss}
        keep = 0
        if self.window == 0 and self.turns[0][0] == "system":
            self.system, keep = (self.turns[0], self.upto[1]), 1
        # older turns can't be repeated again
        keep = max(keep, bisect_left(self.upto, self.upto[-1] - HISTORY))
        self.turns, self.upto = self.turns[keep:], self.upto[keep:]
        self.fresh = len(self.turns)
        self.window += 1
        return out


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512):
    out: list[dict] = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def windows(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, window, text, n_turns, repeated (turns that open it again), n_tokens, loss (spans of text).

    A conversation's windows stand together and in order in one partition.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        encoder = Encoder.of(tokenizer)

        def made():
            now = None
            for conv_id, role, text in _rows(batches, ["conv_id", "role", "text"]):
                if now is None or now.conv_id != conv_id:
                    if now is not None and (out := now.flush()):
                        yield out
                    now = _Conversation(conv_id)
                if out := now.add(role, text, lambda made: len(encoder.raw(made)) // 4):
                    yield out
            if now is not None and (out := now.flush()):
                yield out

        yield from _batches(made(), _WINDOW)

    return rows.mapInArrow(run, "conv_id long, window int, text string, n_turns int, repeated int, n_tokens long, loss array<struct<start: long, end: long>>")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its windows as windows() returns them."""

    def run(batches):
        def made():
            now = None
            for conv_id, text, repeated, loss in _rows(batches, ["conv_id", "text", "repeated", "loss"]):
                if now is None or now["conv_id"] != conv_id:
                    if now is not None:
                        yield now | {k: now[k].hexdigest() for k in ("turns_sha256", "loss_sha256")}
                    now = {"conv_id": conv_id, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                for role, body in read_back(text)[repeated:]:
                    now["n_turns"] += 1
                    now["turns_sha256"].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    now["loss_chars"] += len(target)
                    now["loss_sha256"].update(target.encode())
                now["formatted_chars"] += len(text)
            if now is not None:
                yield now | {k: now[k].hexdigest() for k in ("turns_sha256", "loss_sha256")}

        yield from _batches(made(), _DIGEST)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
