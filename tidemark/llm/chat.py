"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as
context, that reply as the only trained text. Turns that no assistant turn
follows (or a conversation without any) make a last example without a target,
so that no turn is lost. A turn is written

    <|im_start|>role LF text<|im_end|> LF

and every ``<|`` inside a text or role gets a backslash between its two signs
(one more, if there are some already), so texts never hold a control string and
reading back removes exactly what was added. Line feeds and percent signs of a
role are percent-coded.

Turns are sorted by (turn, role, text) within a conversation; null texts and
roles count as empty; conversations with a null id are one conversation.
Repeated rows are repeated turns. Tasks stream over turns sorted by
conversation: they hold one conversation's formatted prefix, never a table of
its examples. The examples of a conversation are as many as its assistant turns
and their text grows with the square of its length, as the method asks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
#: Bytes of examples handed on at once.
_BATCH = 4 << 20


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where its escaped text begins and ends in it."""
    head = f"{START}{_role_out(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; raises if it isn't a sequence of turns."""
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        end = text.find(f"{END}\n", line)
        if not text.startswith(START, at) or line < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((_role_in(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def examples(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, example, n_turns, text, loss_start, loss_end, last)``: one row an assistant turn.

    ``text[loss_start:loss_end]`` (code points) is the only trained text; both
    are equal where there is none. ``last`` marks a conversation's longest
    example. A conversation's examples lie in order in one partition.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    turns = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    names = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "last"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k).cast(pa.string()) if k == pa.large_string() else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        conv, prefix, count, n, pending, seen = None, "", 0, 0, None, False

        def close() -> Iterator[tuple]:
            """The example in hand, which is known to be the last only now."""
            if pending is not None:
                yield (*pending, pending[2] == n)
            if seen and (pending is None or pending[2] != n):
                yield conv, count, n, prefix, len(prefix), len(prefix), True

        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not seen or c != conv:
                    out.extend(close())
                    conv, prefix, count, n, pending, seen = c, "", 0, 0, None, True
                turn, a, b = format_turn(role, text)
                if role == TRAINED and pending is not None:
                    out.append((*pending, False))
                    size += len(pending[3])
                start = len(prefix)
                prefix += turn
                n += 1
                if role == TRAINED:
                    pending = (conv, count, n, prefix, start + a, start + b)
                    count += 1
                if size > _BATCH or len(out) > 5000:
                    yield rows()
                    out.clear()
                    size = 0
        out.extend(close())
        yield rows()

    return turns.mapInArrow(run, "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, last boolean")


def digests(found: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its `examples` alone.

    The longest example gives the turns, each example its trained text.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chars, total = hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for conv, text, a, b, last in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                target = unescape(text[a:b])
                loss.update(target.encode("utf-8", "surrogatepass"))
                chars, total = chars + len(target), total + len(text)
                if last:
                    turns, whole = parse(text), hashlib.sha256()
                    for role, said in turns:
                        whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    out.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), total))
                    loss, chars, total = hashlib.sha256(), 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return found.select("conv_id", "text", "loss_start", "loss_end", "last").mapInArrow(run, schema)
