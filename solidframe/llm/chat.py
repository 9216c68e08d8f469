r"""Chat formatting in budgeted, turn-aligned windows.

A turn is written as ``### role: text </turn>`` and a newline. Inside a role or text a backslash escapes the
next character: backslashes, every ``###`` and every ``</turn>`` (in roles also ``:``), so no text can end or
begin a turn, and unescaping gives the text back.

Turns are written and their tokens counted where they lie, in even partitions. Then the turns of a conversation
stream in order, with the running sum of their tokens. A window holds turns up to ``budget`` tokens: the largest
turn-aligned span whose sum still fits. Each window after the first starts with the system turn and as many of the
last turns, up to ``history`` tokens, as fit beside the next turn; these are repeated, and their targets are
masked: loss spans cover each assistant text once. Nothing is cut: a turn over the budget is the one turn of its
window beside the system turn, which is repeated even where both together exceed the budget.

Conversations are dealt out and sorted by (conv_id, turn); a task holds one window at a time, so a conversation
with a third of all rows needs no more memory than others. The order within a conversation makes it one
task's work, but what that task does is to put written turns together.

Cases: null text or role counts as empty; rows with equal or null turn are ordered as they are written, null
turns first; repeated rows are turns of their own; a null conv_id is one conversation; an empty table gives
no windows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
WINDOWS = "conv_id long, window long, n_repeated long, n_turns long, n_tokens long, text string, loss array<struct<start:long,end:long>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", _LOSS)])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\#\\#\\#").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its escaped text starts and ends in it."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a window; the inverse of joined ``format_turn``."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2][:-1]), m.start(2), m.end(2) - 1))
        at = m.end()
    return out


class _Conversation:
    """Windows of one conversation, from its turns in order; sums are running sums of tokens."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.total = 0
        self.system: list[tuple[str, int]] = []
        self.recent: list[tuple[str, int, int]] = []  # formatted turns and the running sums before and after them
        self.repeated: list[str] = []
        self.own: list[tuple[str, tuple[int, int] | None]] = []
        self.tokens = self.number = 0

    def add(self, role: str, turn: tuple[str, int, int], tokens: int) -> dict | None:
        text, start, end = turn
        done = None
        if self.own and self.tokens + tokens > self.budget:
            done = self.close()
            first = sum(n for _, n in self.system)
            room = min(self.history, self.budget - first - tokens)
            # the running sums give the longest run of last turns within the room
            back = [x for x in self.recent if self.total - x[1] <= room]
            self.repeated = [t for t, _ in self.system] + [t for t, _, _ in back]
            self.tokens = first + (self.total - back[0][1] if back else 0)
        if role == SYSTEM_ROLE and not self.total and not self.own:
            self.system = [(text, tokens)]
        else:
            self.recent.append((text, self.total, self.total + tokens))
            while self.total + tokens - self.recent[0][1] > self.history and len(self.recent) > 1:
                self.recent.pop(0)
        self.own.append((text, (start, end) if role == TARGET_ROLE else None))
        self.tokens += tokens
        self.total += tokens
        return done

    def close(self) -> dict:
        at = sum(map(len, self.repeated))
        loss = []
        for text, span in self.own:
            if span:
                loss.append({"start": at + span[0], "end": at + span[1]})
            at += len(text)
        out = {
            "conv_id": self.conv_id, "window": self.number, "n_repeated": len(self.repeated), "n_turns": len(self.repeated) + len(self.own), "n_tokens": self.tokens,
            "text": "".join(self.repeated) + "".join(t for t, _ in self.own), "loss": loss,
        }
        self.number += 1
        self.own, self.repeated, self.tokens = [], [], 0
        return out


def _rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema)


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())])
TURNS = "conv_id long, turn long, role string, text string, start long, end long, tokens long"


def _written(tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                roles = [x or "" for x in part.column("role").to_pylist()]
                turns = [format_turn(r, t or "") for r, t in zip(roles, part.column("text").to_pylist(), strict=True)]
                counts = [len(x.ids) for x in model.encode_batch([t for t, _, _ in turns], add_special_tokens=False)]
                columns = [part.column("conv_id"), part.column("turn"), pa.array(roles, pa.string()), *(pa.array([t[k] for t in turns], _TURNS.field(3 + k).type) for k in range(3)), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=_TURNS)

    return write


def _windows(budget: int, history: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, found = None, 0, []
        for batch in batches:
            for conv_id, role, text, start, end, tokens in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text", "start", "end", "tokens")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        found.append(now.close())
                    now = _Conversation(conv_id, budget, history)
                done = now.add(role, (text, start, end), tokens)
                if done:
                    found.append(done)
                    size += len(done["text"])
                if size > 1 << 20 or len(found) > 1000:
                    yield _rows(found, _WINDOWS)
                    size, found = 0, []
        if now is not None:
            found.append(now.close())
        if found:
            yield _rows(found, _WINDOWS)

    return windows


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 256, tokenizer: str = TOKENIZER) -> DataFrame:
    """Windows of the conversations in ``turns`` (conv_id, turn, role, text): see ``WINDOWS``.

    ``loss`` has the spans (characters of the window's text) of the assistant texts that count.
    ``n_repeated`` turns at the start are repeated from earlier windows. ``tokenizer`` is a file of the
    tokenizers library that every executor can read.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    written = rows.mapInArrow(_written(tokenizer), TURNS)
    return written.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").mapInArrow(_windows(budget, history), WINDOWS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state, found = None, []

    def ended() -> dict:
        conv_id, n, turns, chars, loss, size = state
        return dict(zip(schema.names, (conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size), strict=True))

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or state[0] != row["conv_id"]:
                if state is not None:
                    found.append(ended())
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse_turns(row["text"])[row["n_repeated"] :]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                target = unescape(row["text"][span["start"] : span["end"]])
                state[3] += len(target)
                state[4].update(target.encode())
            state[5] += len(row["text"])
        if found:
            yield _rows(found, schema)
            found = []
    if state is not None:
        yield _rows([ended()], schema)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from formatted windows alone: digests of its turns and of its targets."""
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_digests, DIGESTS)
