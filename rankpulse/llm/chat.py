"""Conversations rendered by a template, with the spans that a model is trained to produce, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, in_arrow
from .templates import compile_template

#: Marks each turn by `### role` and `</turn>`; what an assistant says is marked as generation.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role|name }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: Control strings inside texts lose their first character to a code; a code begins with a backslash, which is doubled itself.
_CODES = {"\\": "\\\\", "<": "\\l", "#": "\\h", "\n": "\\n"}
_CONTROL = re.compile(r"\\|<(?=/turn>)|#(?=##)")
_CONTROL_NAME = re.compile(r"\\|<(?=/turn>)|#(?=##)|\n")
_CODE = re.compile(r"\\(.)", re.S)
_BACK = {v[1]: k for k, v in _CODES.items()}
_TURN = re.compile(r"### ([^\n]*)\n(.*?)</turn>\n", re.S)


def escape(text: str | None) -> str:
    return _CONTROL.sub(lambda m: _CODES[m[0]], text or "")


def escape_name(text: str | None) -> str:
    return _CONTROL_NAME.sub(lambda m: _CODES[m[0]], text or "")


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _BACK.get(m[1], m[1]), text)


FILTERS = {"escape": escape, "name": escape_name, "trim": lambda x: (x or "").strip(), "upper": lambda x: (x or "").upper(), "lower": lambda x: (x or "").lower(), "length": lambda x: len(x or "")}


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (code points) of each conversation.

    turns: conv_id, turn, role, text; other columns are dropped. Turns go by turn, nulls first, ties by role and text, repeated rows stay.
    Null roles and texts are empty; rows of a null conv_id are one conversation. Rows are dealt by conv_id and sorted; a task holds
    one conversation at a time, which is a string in the end.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        held: list[dict] = []
        current, out, chars = object(), [], 0

        def close():
            nonlocal chars
            if held:
                text, spans = render({"messages": held})
                out.append((current, len(held), text, [{"start": a, "end": b} for a, b in spans]))
                chars += len(text)

        for batch in batches:
            for conv_id, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not held or conv_id != current:
                    close()
                    held, current = [], conv_id
                    if chars > 8_000_000:
                        yield _formatted(out)
                        out, chars = [], 0
                held.append({"role": role, "text": text})
        close()
        if out:
            yield _formatted(out)

    return in_arrow(dealt, run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>")


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = (pa.int64(), pa.int64(), pa.string(), span)
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["conv_id", "n_turns", "formatted", "loss_spans"])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation that TEMPLATE rendered."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError("this isn't such a conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the rendered text and its spans alone."""

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for conv_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = read_turns(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch([pa.array([r[i] for r in out], pa.string() if n.endswith("256") else pa.int64()) for i, n in enumerate(names)], names)

        return one

    return arrow_map(formatted.select("conv_id", "formatted", "loss_spans"), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", start)
