"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, that reply as the only trainable span. Turns after the last
reply (or a conversation without one) come as one more example without a span, so the output holds every turn. Turns are marked
``### role ###`` newline ... ``</turn>``; in roles and texts backslash, ``#`` and ``<`` are written as two-character escapes, so no mark can occur
there, and undone exactly.

Rows are dealt by conversation and sorted by turn; a task keeps the text of one conversation at a time, which its longest example must hold anyway.
The examples of a conversation of n turns hold about n * n / 2 turns: that is the method's output, not an intermediate.

Cases: null texts and roles are empty; equal turn numbers are ordered by role, then text (nulls as empty), so repeated rows stay side by side as turns
of their own; a null conv_id is a conversation; null turns come first; an empty table gives no examples; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPLY_ROLE = "assistant"
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
PLAIN = {written: plain for plain, written in ESCAPES.items()}
CONTROL = re.compile(r"[\\#<]")
ESCAPED = re.compile(r"\\[\\hl]")
TURN = re.compile(r"### (.*?) ###\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m[0]], text)


def opened(role: str) -> str:
    return f"### {escape(role)} ###\n"


def closed(text: str) -> str:
    return f"{escape(text)}</turn>\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def expand(conversations: DataFrame) -> DataFrame:
    """Examples in order of conversation and turn: conv_id, example, text, loss_start, loss_end (code points; null without a span)."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, prefix, number, tail, length = False, None, [], 0, False, 0
        for batch in batches:
            key_type, out = batch.column(0).type, []
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for key, role, text in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    if not started or key != conv:
                        if tail:
                            out.append((conv, number, "".join(prefix), None, None))
                        started, conv, prefix, number, tail, length = True, key, [], 0, False, 0
                    head, body = opened(role), closed(text)
                    begin = length + len(head)
                    prefix += [head, body]
                    length = begin + len(body)
                    tail = role != REPLY_ROLE
                    if not tail:
                        prefix = ["".join(prefix)]
                        out.append((conv, number, prefix[0], begin, length - len("</turn>\n")))
                        number += 1
                    if len(out) >= 64 or out and len(out[-1][2]) > 1 << 20:
                        yield examples(out, key_type)
                        out = []
            if out:
                yield examples(out, key_type)
        if tail:
            yield examples([(conv, number, "".join(prefix), None, None)], key_type)

    def examples(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "example", "text", "loss_start", "loss_end"])

    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("turn").mapInArrow(run, f"conv_id {kind}, example long, text string, loss_start long, loss_end long")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (over its examples).

    ``examples`` as ``expand`` returns them: those of a conversation together and in order. One example is held at a time.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, conv, last, loss, loss_chars, chars = False, None, "", hashlib.sha256(), 0, 0

        def done() -> tuple:
            digest, turns = hashlib.sha256(), turns_of(last)
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            return conv, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            key_type, out = batch.column(0).type, []
            for i in range(batch.num_rows):
                key, example, text, start, end = (batch.column(c)[i].as_py() for c in range(5))
                if example == 0:
                    if open_conv:
                        out.append(done())
                    open_conv, conv, loss, loss_chars, chars = True, key, hashlib.sha256(), 0, 0
                if start is not None:
                    reply = unescape(text[start:end])
                    loss.update(reply.encode())
                    loss_chars += len(reply)
                last, chars = text, chars + len(text)
            if out:
                yield batch_of(out)
        if open_conv:
            yield batch_of([done()])

    return examples.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
