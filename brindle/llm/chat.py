"""Chat formatting by incremental black-box rendering.

A template is any function from messages (``{"role", "content"}`` dicts, in
order) to text; nothing about its inside is known.  To find where each turn lies
in the text, the conversation's prefixes of 1, 2, .. turns are rendered, and each
output is compared with the one before:

* if the new output begins with the old one, the turn is what was added;
* if not, the template *rewrites history*: the turn's span begins where the two
  outputs part, ``rewrites`` is set, and spans of earlier turns that reach beyond
  that place are cut there, since their text has changed.

A conversation of n turns is rendered n times, so the work grows with the square of its
length: that is the price of knowing nothing about the template.

Spans are character offsets into the rendering of the whole conversation, so
they can mask a training loss; conversations with a rewriting template can be
told apart and left out.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.runtime import prepare

Template = Callable[[list[dict[str, str]]], str]
FIELDS = "template string, conv_id bigint, position int, turn bigint, role string, span_start int, span_end int, piece string, rewrites boolean"


def chatml(messages: list[dict[str, str]]) -> str:
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)


def bracketed(messages: list[dict[str, str]]) -> str:
    """System text goes into the first user turn; a later system turn replaces it there."""
    system = "".join(m["content"] for m in messages if m["role"] == "system")
    out, first = [], True
    for m in messages:
        if m["role"] == "user":
            lead = f"<<SYS>>\n{system}\n<</SYS>>\n\n" if first and system else ""
            out.append(f"<s>[INST] {lead}{m['content']} [/INST]")
            first = False
        elif m["role"] != "system":
            out.append(f" {m['content']} </s>")
    return "".join(out)


def last_answer(messages: list[dict[str, str]]) -> str:
    """Only the last answer is kept whole; earlier ones shrink to a mark: it rewrites history."""
    last = max((i for i, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    return "".join(f"<{m['role']}>{m['content'] if m['role'] != 'assistant' or i == last else '...'}</{m['role']}>" for i, m in enumerate(messages))


def turn_spans(messages: list[dict[str, str]], template: Template) -> tuple[str, list[tuple[int, int, bool]]]:
    """The whole rendering, and ``(start, end, rewrites)`` for each turn."""
    spans: list[tuple[int, int, bool]] = []
    before = ""
    for n in range(1, len(messages) + 1):
        now = template(messages[:n])
        if now.startswith(before):
            spans.append((len(before), len(now), False))
        else:
            part = len(os.path.commonprefix([before, now]))
            spans = [(min(s, part), min(e, part), r) for s, e, r in spans]
            spans.append((part, len(now), True))
        before = now
    return before, spans


TEMPLATES: dict[str, Template] = {"chatml": chatml, "bracketed": bracketed, "last_answer": last_answer}


def _render(batches: Iterator[pa.RecordBatch], templates: dict[str, Template]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in FIELDS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for name, template in templates.items():
                text, spans = turn_spans([{"role": t["role"], "content": t["content"]} for t in turns], template)
                for i, (t, (start, end, rewrites)) in enumerate(zip(turns, spans, strict=True)):
                    rows.append((name, conv, i, t["turn"], t["role"], start, end, text[start:end], rewrites))
                size += len(text)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_turns(conversations: DataFrame, templates: dict[str, Template] = TEMPLATES, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn and template: the turn's span in its conversation's rendering, and the text there.

    ``position`` counts a conversation's rows in the order of (turn, role, text),
    nulls first, so ties and repeated rows have a fixed order, and every row is a
    turn.  A null role or text is an empty one; rows without a conversation id are
    left out.  ``rewrites`` tells that the turn changed earlier output.
    """
    prepare(conversations.sparkSession)
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").cast("bigint").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("content")).alias("said"),
    ).where("conv_id is not null")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return whole.mapInArrow(lambda it: _render(it, templates), FIELDS)
