"""Content-defined anchors: where equal passages meet in a shuffle.

Take all windows of ``span`` words.  Each contains ``span - GRAM + 1`` runs of
``GRAM`` words, and its *anchor* is the run with the least hash (the leftmost, if
several).  The anchor depends on the window's words alone, so equal windows,
wherever they are, have equal anchors at equal places.  One shuffle by anchor
hash therefore brings all copies of every window together.  Neighbouring windows
mostly share an anchor; such a *segment* of windows travels as one row.

Positions are word numbers within a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.textkernel import RADIX_INV, U64, Words, mix, powers, window_hashes, window_ok

#: Words of a repeated passage, and of an anchor.
SPAN, GRAM = 50, 10
RUNS = "doc_id bigint, start int, n int, ref_id bigint, ref_start int"
SPANS = "doc_id bigint, start_word int, end_word int, ref_id bigint, ref_start int"


@dataclass
class Segments:
    """Segment ``i``: windows that start at words ``at[i] .. at[i] + n[i] - 1`` of the batch."""

    key: np.ndarray
    at: np.ndarray
    n: np.ndarray
    off: np.ndarray  # words from the first window's start to the anchor


def segments(words: Words, hashed: np.ndarray, span: int, gram: int = GRAM) -> Segments:
    """All windows of the batch's texts, by anchor; texts of fewer than ``span`` words have none."""
    gram = min(gram, span)
    ok = window_ok(words.first, span)
    if not ok.any():
        none = np.zeros(0, dtype=np.int64)
        return Segments(none, none, none, none)
    value = window_hashes(hashed, gram)
    place = np.arange(len(value), dtype=np.int32)
    least, best, have, width = value, place, 1, span - gram + 1
    while have < width:
        step = min(have, width - have)
        left, right = least[: len(least) - step], least[step:]
        take = left <= right
        least, best = np.where(take, left, right), np.where(take, best[: len(take)], best[step:])
        have += step
    starts = np.flatnonzero(ok)
    chosen = best[starts]
    edge = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    at, anchor = starts[edge], chosen[edge].astype(np.int64)
    return Segments(value[anchor].view(np.int64), at, np.diff(np.append(edge, len(starts))), anchor - at)


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array whose items are the next ``sizes`` bytes of ``data`` each."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array, and where its items begin and end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ..`` (``n[i]`` numbers) for every ``i``."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


#: A row is a segment with its content, or, without content, a run that is known already.
ROWS = "key bigint, doc_id bigint, start int, content binary, n int, ref_id bigint, ref_start int"
COMBINE_BYTES = 6 << 20


def run_hashes(hashed: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``size[i]`` words from each of ``at`` on; not those of :func:`window_hashes`."""
    sums = np.zeros(len(hashed) + 1, dtype=U64)
    np.cumsum(mix(hashed) * powers(len(hashed)), out=sums[1:])
    return mix((sums[at + size] - sums[at]) * powers(int(at.max(initial=0)) + 1, RADIX_INV)[at] + size.astype(U64))


class _Seen:
    """Segments of this task so far: contents (two hashes) and where each is first.

    Sorted arrays, each more than twice as long as the next, so a segment is merged
    a logarithmic number of times.
    """

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []

    def find(self, check: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each segment is known, and where it was first: (known, doc, start)."""
        known, doc, start = np.zeros(len(check), dtype=bool), np.zeros(len(check), np.int64), np.zeros(len(check), np.int64)
        for c, k, d, s in reversed(self.parts):  # newer parts hold earlier places
            at = np.minimum(np.searchsorted(c, check), len(c) - 1)
            hit = ~known & (c[at] == check) & (k[at] == key)
            known |= hit
            doc[hit], start[hit] = d[at[hit]], s[at[hit]]
        return known, doc, start

    def add(self, check: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        part = [check, key, doc, start]
        while self.parts and len(self.parts[-1][0]) <= 2 * len(part[0]):
            part = [np.concatenate([new, old]) for new, old in zip(part, self.parts.pop(), strict=True)]
        order = np.argsort(part[0], kind="stable")
        if len(order):
            self.parts.append([x[order] for x in part])


def combine(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Segments ``(key, doc_id, start, n, content, check)`` as ``ROWS``, each content once a task.

    The first of equal segments (by anchor and ``check``, a hash of all its words: 128 bits) is
    sent on; the others repeat it, and only that is sent.  A segment that comes later in the
    input but earlier in the order of ids is sent too.  So a passage that millions of
    documents share is not as many rows of content at the one place where they meet, but
    one for each task that reads the input.
    """
    names = [x.split()[0] for x in ROWS.split(", ")]
    seen = _Seen()

    def out(held: list[tuple]) -> pa.RecordBatch:
        key, doc, start, n, check = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 3, 5))
        content = pa.concat_arrays([h[4] for h in held])
        order = np.lexsort((start, doc, key, check))
        k, c, d, s = key[order], check[order], doc[order], start[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        again = np.concatenate([[False], ~new[1:] & (d[1:] == d[:-1]) & (s[1:] == s[:-1])])  # a repeated row
        group = np.cumsum(new) - 1
        known, of_doc, of_start = seen.find(c[new], k[new])
        later = known & ((of_doc < d[new]) | ((of_doc == d[new]) & (of_start <= s[new])))
        of_doc, of_start = np.where(later, of_doc, d[new]), np.where(later, of_start, s[new])
        first = order[new][~later]
        seen.add(c[new][~later], k[new][~later], d[new][~later], s[new][~later].astype(np.int64))
        copy = ~again & ~((d == of_doc[group]) & (s == of_start[group]))
        rest, of_doc, of_start = order[copy], of_doc[group][copy], of_start[group][copy].astype(np.int32)
        none = lambda kind: pa.nulls(len(first), kind)
        segment_rows = [pa.array(key[first]), pa.array(doc[first]), pa.array(start[first]), content.take(pa.array(first)), none(pa.int32()), none(pa.int64()), none(pa.int32())]
        run_rows = [pa.array(doc[rest]), pa.array(doc[rest]), pa.array(start[rest]), pa.nulls(len(rest), pa.binary()), pa.array(n[rest].astype(np.int32)), pa.array(of_doc), pa.array(of_start)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(segment_rows, run_rows, strict=True)], names)

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part[4].nbytes
        if size >= COMBINE_BYTES:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def meet(rows: DataFrame, solve: Callable[[pa.Table], pa.RecordBatch], span: int, schema: str = SPANS, then: Callable | None = None) -> DataFrame:
    """Bring segments together by anchor, ``solve`` whole lists of them, and join all runs to spans.

    ``then`` is done to the spans, sorted by document and start, and gives rows of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []

        def contents() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = batch.column(3).is_null()
                if done.true_count:
                    part = batch.filter(done)
                    known.append(pa.RecordBatch.from_arrays([part.column(i) for i in (1, 2, 4, 5, 6)], ["doc_id", "start", "n", "ref_id", "ref_start"]))
                    batch = batch.filter(pc.invert(done))
                yield batch.select([0, 1, 2, 3])

        for table in lists(contents()):
            yield solve(table)
            yield from known
            known.clear()
        yield from known

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "start")
    found = sorted_rows.mapInArrow(run, RUNS).repartition("doc_id").sortWithinPartitions("doc_id", "start")
    return found.mapInArrow(lambda it: _join_runs(it, span) if then is None else then(_join_runs(it, span)), schema)


def lists(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole lists, of two rows or more, out of batches sorted by their first column."""
    held: list[pa.Table] = []
    have = 0

    def out(table: pa.Table) -> pa.Table:
        key = table.column(0).to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        alone = new & np.concatenate([new[1:], [True]])
        return table.filter(pa.array(~alone)).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held.append(table)
        have += batch.num_rows
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
        if have >= rows and (cut or held[0].column(0)[0].as_py() != key[-1]):
            whole = pa.concat_tables(held)
            first = int(np.searchsorted(whole.column(0).to_numpy(), key[-1]))
            yield out(whole.slice(0, first))
            held, have = [whole.slice(first)], len(whole) - first
    if held:
        yield out(pa.concat_tables(held))


def runs(doc: np.ndarray, start: np.ndarray, ref: np.ndarray, ref_start: np.ndarray) -> pa.RecordBatch:
    """Repeated windows, joined to runs along one diagonal of one reference."""
    order = np.lexsort((start, doc))
    doc, start, ref, ref_start = doc[order], start[order], ref[order], ref_start[order]
    if not len(doc):
        edge = np.zeros(0, dtype=np.int64)
    else:
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (ref[1:] != ref[:-1]) | (ref_start[1:] != ref_start[:-1] + 1)]))
    n = np.diff(np.append(edge, len(doc)))
    return pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array(start[edge].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ref[edge]), pa.array(ref_start[edge].astype(np.int32))], ["doc_id", "start", "n", "ref_id", "ref_start"])


def _join_runs(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by document and start, joined where one goes on with the same reference."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        doc, start, n, ref, ref_start = (c.to_numpy() for c in batch.columns)
        go_on = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + n[:-1]) & (ref[1:] == ref[:-1]) & (ref_start[1:] - start[1:] == ref_start[:-1] - start[:-1])
        edge = np.flatnonzero(np.concatenate([[True], ~go_on]))
        total = np.add.reduceat(n, edge)
        joined = pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array(start[edge]), pa.array(total.astype(np.int32)), pa.array(ref[edge]), pa.array(ref_start[edge])], batch.schema.names)
        last = joined.slice(len(edge) - 1)
        yield _as_spans(joined.slice(0, len(edge) - 1), span)
    if last is not None:
        yield _as_spans(last, span)


def _as_spans(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    doc, start, n, ref, ref_start = batch.columns
    end = pa.array(start.to_numpy() + n.to_numpy() + np.int32(span - 1), pa.int32())
    return pa.RecordBatch.from_arrays([doc, start, end, ref, ref_start], ["doc_id", "start_word", "end_word", "ref_id", "ref_start"])


def covered(spans: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: each document's spans, overlaps merged, as sorted (start, end) pairs."""
    spans = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("all"))
    merged = F.aggregate(
        "all",
        F.array().cast("array<struct<start_word:int,end_word:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end_word"] >= x["start_word"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start_word"].alias("start_word"), F.greatest(F.try_element_at(acc, F.lit(-1))["end_word"], x["end_word"]).alias("end_word"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return spans.select("doc_id", merged.alias("spans"))
