r"""Chat formatting: turn-aligned windows of a token budget, with a loss mask.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Control strings inside roles and texts are escaped reversibly:
``<``, any backslashes and ``|`` get one more backslash between them, so ``<|im_end|>`` inside a text becomes
``<\|im_end|>``; line feeds of a role become ``\n`` and its backslashes are doubled first.

Prefix sums of turn tokens choose the windows. A window starts with the system turn (the first turn, if its role is
system), repeats the latest turns before its new ones as far as ``history`` tokens go, and takes new turns while the
budget lasts, one at least; a turn that is longer than the budget alone is kept whole. The loss mask holds the text of
each assistant turn in the window where it is new; repeated turns are masked.

A conversation is read in order as a stream: rows are hash-partitioned by conversation and sorted, and a task holds the
open window and the system turn only, so a conversation of any length passes in bounded memory.

Defined cases: null text or role is empty; rows are ordered by turn (null first), then role and text, repeated rows stay;
a null conv_id is a conversation; other columns are ignored. An empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

START, END = "<|im_start|>", "<|im_end|>\n"
_CLOSE, _OPEN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
WINDOWS = ("conv_id string, window_no int, text string, n_tokens long, first_new int, last_turn int, turns array<int>, loss_start array<long>, "
           "loss_end array<long>")


def escape(text: str) -> str:
    return _CLOSE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPEN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class _Conversation:
    """The open window of one conversation."""

    def __init__(self, conv_id, budget: int, history: int):
        self.id, self.budget, self.history = conv_id, budget, history
        self.windows = self.seen = 0
        self.system = None  # (number, written turn, tokens, where its text starts)
        self.recent: list = []  # the latest turns, at most the history budget
        self.open: list = []  # the turns of the open window, repeated ones first
        self.new = self.tokens = 0

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        """Take one turn; returns the window that it closes."""
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        turn = (self.seen, head + body + END, tokens, len(head), len(body), role == "assistant")
        closed = None
        if self.new and self.tokens + tokens > self.budget:
            closed = self.close()
        if not self.open:
            room = self.budget - tokens
            if self.system:
                self.open.append(self.system)
                room -= self.system[2]
            for t in self._history(min(self.history, room)):
                self.open.append(t)
            self.tokens = sum(t[2] for t in self.open)
            self.first_new = self.seen
        self.open.append(turn)
        self.new += 1
        self.tokens += tokens
        if self.seen == 0 and role == "system":
            self.system = turn
        else:
            self.recent.append(turn)
            total = sum(t[2] for t in self.recent)
            while self.recent and total > self.history:
                total -= self.recent.pop(0)[2]
        self.seen += 1
        return closed

    def _history(self, room: int) -> list:
        """The latest turns whose tokens fit, from prefix sums counted from the end."""
        total, k = 0, 0
        for t in reversed(self.recent):
            total += t[2]
            if total > room:
                break
            k += 1
        return self.recent[len(self.recent) - k:]

    def close(self) -> dict:
        parts, loss_start, loss_end, at = [], [], [], 0
        for n, written, _, head, body, target in self.open:
            if target and n >= self.first_new:
                loss_start.append(at + head)
                loss_end.append(at + head + body)
            parts.append(written)
            at += len(written)
        row = {"conv_id": self.id, "window_no": self.windows, "text": "".join(parts), "n_tokens": self.tokens, "first_new": self.first_new,
               "last_turn": self.seen - 1, "turns": [t[0] for t in self.open], "loss_start": loss_start,
               "loss_end": loss_end}
        self.windows += 1
        self.open, self.new, self.tokens = [], 0, 0
        return row


def _ordered(turns: DataFrame) -> DataFrame:
    d = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_windows(turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 256) -> DataFrame:
    """Windows of all conversations, one row each: text, tokens, the turns it holds and the spans of its loss mask in code
    points of ``text``. ``tokenizer`` is the path of a tokenizers file that every executor has.

    Rows of a conversation come in order inside one partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        now, overhead = None, len(tok.encode(f"{START}\n{END}", add_special_tokens=False).ids)
        for batch in batches:
            rows = []
            sizes = []
            for k in range(0, len(batch), 256):  # few at a time: encodings are large
                some = [f"{r}\n{t}" for r, t in zip(batch["role"][k:k + 256], batch["text"][k:k + 256])]
                sizes += [len(e.ids) for e in tok.encode_batch_fast(some, add_special_tokens=False)]
            for conv, role, text, n in zip(batch["conv_id"], batch["role"], batch["text"], sizes):
                if now is None or now.id != conv:
                    if now is not None:
                        rows.append(now.close())
                    now = _Conversation(conv, budget, history)
                done = now.add(role, text, n + overhead)
                if done:
                    rows.append(done)
            yield _frame(rows)
        if now is not None:
            yield _frame([now.close()])

    return _ordered(turns).mapInPandas(run, WINDOWS).withColumn("conv_id", F.col("conv_id").cast("long"))


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "window_no", "text", "n_tokens", "first_new", "last_turn", "turns", "loss_start", "loss_end"])


DIGEST = ("conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, "
          "most_tokens long")


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations as the windows tell them: turns parsed out of the texts (each where it is new) and the unmasked text, as digests.

    Expects the windows of a conversation in order in one partition, as format_windows gives them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            rows = []
            for w in batch.itertuples(index=False):
                if now is None or now["conv_id"] != w.conv_id:
                    if now is not None:
                        rows.append(_digest(now))
                    now = {"conv_id": w.conv_id, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(),
                           "formatted_chars": 0, "n_windows": 0, "most_tokens": 0}
                for number, m in zip(w.turns, _TURN.finditer(w.text)):
                    if number >= w.first_new:
                        now["n_turns"] += 1
                        now["turns"].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for start, end in zip(w.loss_start, w.loss_end):
                    text = unescape(w.text[start:end])
                    now["loss_chars"] += len(text)
                    now["loss"].update(text.encode())
                now["formatted_chars"] += len(w.text)
                now["n_windows"] += 1
                now["most_tokens"] = max(now["most_tokens"], w.n_tokens)
            yield _digests(rows)
        if now is not None:
            yield _digests([_digest(now)])

    texts = windows.withColumn("conv_id", F.col("conv_id").cast("string"))
    return texts.mapInPandas(run, DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))


def _digest(c: dict) -> tuple:
    return (c["conv_id"], c["n_turns"], c["turns"].hexdigest(), c["loss_chars"], c["loss"].hexdigest(), c["formatted_chars"], c["n_windows"],
            c["most_tokens"])


def _digests(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])
