"""Substring dedup by relative Lempel-Ziv parsing.

Every document is parsed against the whole corpus.  The *reference* is made of
the blocks of ``min_words`` words at their first occurrence (the first within a
task's input, so that copies there needn't travel, and the least ``(doc_id, position)``
of those); the *index* is a shuffle by content-defined anchors
(:mod:`brindle.llm.anchors`), which brings a block and all its copies together.
It tells where a document may enter a reference, and on which diagonal.

1. Blocks of a document that enter one reference one after the other are a run.  A
   run with no repeated block right before or behind it is a factor as it is: a
   reference that went on to agree would make the next block a repeated one.
2. Runs that touch form a *chain*: there one reference ends and another one is
   entered, though the first may well go on.  For chains the words of the document
   and of the references that it enters are fetched, and it is parsed from left to
   right: at a word, the factor is the longest agreement, word by word, with any of the
   references on the diagonals of their entries; the parse goes on at its end.
3. At such a boundary the next factor is looked up to the left as well: a reference
   that agrees across the boundary is taken from where it begins to agree, so factors of
   ``min_words`` words are found that begin before it.  Those become duplicate spans.

The union of the spans is exactly the set of words inside a block of
``min_words`` words that occurred before, in an earlier document or earlier in
the same one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from brindle.llm.anchors import ROWS, SPAN, SPANS, binary, combine, flat, meet, run_hashes, runs, segments, spread
from brindle.llm.runtime import materialise, named, prepare
from brindle.llm.textkernel import chunks, window_hashes

#: Bytes of a block's hash that travel; the anchor's own eight bytes add to them.
KEEP = 8
#: Requests for one text that travel as one row.
TOGETHER = 1024
CHAINS = SPANS + ", chain int, chain_end int"
PARTS = "doc_id bigint, chain int, kind int, at int, end int, ref_id bigint, ref_start int, words binary"


def _blocks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple]:
    """Segments, with their blocks' hashes as content."""
    for batch in batches:
        for part, words in chunks(batch, "text"):
            hashed = words.hashes()
            found = segments(words, hashed, span)
            if not len(found.at):
                continue
            doc = np.searchsorted(words.first, found.at, side="right") - 1
            values = window_hashes(hashed, span)[spread(found.at, found.n)]
            start = (found.at - words.first[doc]).astype(np.int32)
            yield found.key, part.column(0).to_numpy()[doc], start, found.n, binary(values.view(np.uint8), found.n * KEEP), run_hashes(hashed, found.at, found.n + span - 1)


def factor(table: pa.Table) -> pa.RecordBatch:
    """Blocks that aren't the first of their kind, and where the first is."""
    if not table.num_rows:
        none = np.zeros(0, dtype=np.int64)
        return runs(none, none, none, none)
    key = table.column(0).to_numpy()
    data, edge = flat(table.column(3).combine_chunks())
    n = np.diff(edge) // KEEP
    value = np.ascontiguousarray(data).view(np.uint64)
    owner = np.repeat(np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])), n)
    doc, start = np.repeat(table.column(1).to_numpy(), n), spread(table.column(2).to_numpy().astype(np.int64), n)
    order = np.lexsort((start, doc, value, owner))
    owner, value, doc, start = owner[order], value[order], doc[order], start[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])  # a repeated row
    hit = ~new & ~again & ~((doc == doc[first]) & (start == start[first]))
    return runs(doc[hit], start[hit], doc[first[hit]], start[first[hit]])


def _chain(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Spans sorted by document and start, with the place of the chain that they are in, or -1."""

    def out(part: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch:
        size = np.diff(np.append(edge, part.num_rows))
        start, end = part.column(1).to_numpy(), part.column(2).to_numpy()
        chain = np.where(size > 1, start[edge], -1) if len(edge) else edge
        last = np.maximum.reduceat(end, edge) if len(edge) else edge
        more = [pa.array(np.repeat(x, size).astype(np.int32)) for x in (chain, last)]
        return pa.RecordBatch.from_arrays([*part.columns, *more], [x.split()[0] for x in CHAINS.split(", ")])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        doc, start, end = (batch.column(i).to_numpy() for i in range(3))
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1] - span + 1)]))
        yield out(batch.slice(0, int(edge[-1])), edge[:-1])
        held = batch.slice(int(edge[-1]))
    if held is not None:
        yield out(held, np.zeros(1, dtype=np.int64))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that are wanted of each text, as their hashes."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    for batch in batches:
        for part, words in chunks(batch, "text"):
            hashed = words.hashes()
            rows: list[tuple] = []
            for i, (text_id, wanted) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                first, end = int(words.first[i]), int(words.first[i + 1])
                for w in wanted:
                    found = hashed[min(end, first + w["lo"]) : min(end, first + w["hi"])]
                    rows.append((w["doc_id"], w["chain"], w["kind"], w["lo"], w["hi"], text_id, w["lo"], found.tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], names)


def parse(words: np.ndarray, references: dict[int, tuple[int, np.ndarray]], entries: list[tuple[int, int, int]], span: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors ``(start, end, ref_id, ref_start)`` of ``words``.

    ``references`` has, for each reference, the place of its first word here and its
    words; ``entries`` are ``(start, ref_id, ref_start)``: word ``start`` may be copied from there.
    """
    found: set[tuple[int, int, int, int]] = set()
    diagonals = sorted({(ref, place - start) for start, ref, place in entries if ref in references})
    for ref, shift in diagonals:
        base, other = references[ref]
        lo, hi = max(0, base - shift), min(len(words), base + len(other) - shift)
        if hi - lo < span:
            continue
        same = np.concatenate([[False], words[lo:hi] == other[lo + shift - base : hi + shift - base], [False]])
        turn = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if e - s >= span:
                found.add((lo + s, lo + e, ref, lo + s + shift))
    out: list[tuple[int, int, int, int]] = []
    at, active, coming = 0, [], sorted(found, reverse=True)
    while at < len(words):
        while coming and coming[-1][0] <= at:
            active.append(coming.pop())
        active = [x for x in active if x[1] > at]
        if active:
            best = min(active, key=lambda x: (-x[1], x[0], x[2], x[3]))
            out.append(best)
            at = best[1]
        elif coming:
            at = coming[-1][0]
        else:
            break
    return out


def _parse(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Factors of whole chains, whose parts come sorted by document, chain and kind (0: own words, 1: a reference's, 2: an entry)."""
    rows: list[tuple] = []

    def solve(doc: int, chain: int, parts: list[tuple]) -> None:
        own = {p[7] for p in parts if p[2] == 0}
        entries = [p for p in parts if p[2] == 2]
        texts = {(p[5], p[6], p[7]) for p in parts if p[2] == 1}
        if len(own) != 1 or len({t[0] for t in texts}) != len(texts):  # texts that share an id: the runs are the factors
            rows.extend((doc, p[3], p[4], p[5], p[6]) for p in entries)
            return
        words = np.frombuffer(own.pop(), dtype=np.uint64)
        references = {ref: (lo, np.frombuffer(data, dtype=np.uint64)) for ref, lo, data in texts}
        for s, e, ref, place in parse(words, references, [(p[3] - chain, p[5], p[6]) for p in entries], span):
            rows.append((doc, chain + s, chain + e, ref, place))

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], [x.split()[0] for x in SPANS.split(", ")])
        rows.clear()
        return made

    key, parts = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if key is not None:
                    solve(*key, parts)
                key, parts = row[:2], []
            parts.append(row)
        if len(rows) > 10_000:
            yield out()
    if key is not None:
        solve(*key, parts)
    yield out()


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = SPAN) -> DataFrame:
    """``(doc_id, start_word, end_word, ref_id, ref_start)``: the long factors of every document.

    Words ``start_word .. end_word - 1`` of ``doc_id`` repeat those of ``ref_id``
    from ``ref_start`` on.  Words are runs of characters other than ASCII white
    space; case and punctuation count.  A passage's first occurrence has no row.
    Null and short texts have none, rows without an id are left out, and rows
    that repeat a whole row (same id, same text) count once.
    """
    prepare(docs.sparkSession)
    texts = named(docs, id_col, text_col)
    rows = texts.mapInArrow(lambda it: combine(_blocks(it, min_words)), ROWS)
    found = materialise(meet(rows, factor, min_words, CHAINS, lambda it: _chain(it, min_words)))
    tangled = found.where("chain >= 0")
    # of every reference of a chain, the words on all diagonals of its entries; of the document, its own
    shift = F.col("ref_start") - F.col("start_word")
    lo, hi = F.greatest(F.col("chain") + F.min(shift), F.lit(0)), F.col("chain_end") + F.max(shift)
    theirs = tangled.groupBy("ref_id", "doc_id", "chain", "chain_end").agg(lo.alias("lo"), hi.alias("hi")).select(F.col("ref_id").alias("text_id"), "doc_id", "chain", F.lit(1).alias("kind"), "lo", "hi")
    own = tangled.groupBy("doc_id", "chain").agg(F.max("chain_end").alias("hi")).select(F.col("doc_id").alias("text_id"), "doc_id", "chain", F.lit(0).alias("kind"), F.col("chain").alias("lo"), "hi")
    wanted = materialise(theirs.unionAll(own))
    # requests for one text are bundled, but a text that many ask for gets many bundles
    bundles = wanted.groupBy("text_id").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("bundles"))
    bundle = F.pmod(F.xxhash64("doc_id", "chain"), F.col("bundles"))
    asked = wanted.join(bundles, "text_id").groupBy("text_id", bundle.alias("bundle")).agg(F.collect_list(F.struct("doc_id", "chain", "kind", "lo", "hi")).alias("wanted"))
    parts = texts.join(asked, F.col("doc_id") == F.col("text_id")).select("text_id", "text", "wanted").mapInArrow(_fetch, PARTS)
    entries = tangled.select("doc_id", "chain", F.lit(2).alias("kind"), F.col("start_word").alias("at"), F.col("end_word").alias("end"), "ref_id", "ref_start", F.lit(None).cast("binary").alias("words"))
    chains = parts.unionAll(entries).repartition("doc_id", "chain").sortWithinPartitions("doc_id", "chain", "kind", "at")
    names = [x.split()[0] for x in SPANS.split(", ")]
    return found.where("chain < 0").select(names).unionAll(chains.mapInArrow(lambda it: _parse(it, min_words), SPANS))
