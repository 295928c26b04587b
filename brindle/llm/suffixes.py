"""Suffix-array dedup by deep-shallow sorting.

The corpus' suffixes, one a word, are sorted by their first ``min_words`` words;
neighbours that share all of them are copies of one passage.  The array is
sorted in pieces: suffixes that begin with the same ``min_words`` words have the
same content-defined anchor (:mod:`brindle.llm.anchors`), so a shuffle by anchor
hash leaves every group of equal suffixes whole in one piece, and each piece is
sorted on its own.  A segment of neighbouring suffixes travels as one row with
its words as 16-bit codes, and 32 bits of each suffix's own hash over its ``min_words``
words: suffixes of equal codes are held to be equal only if those agree as well (two
that differ in one word agree by chance once in 2**48).

Within a piece:

* segments with equal words are copies throughout; one of each goes on;
* **shallow**: multikey quicksort, all groups at once: a group of suffixes is
  split by its next word's code, to a depth of ``SHALLOW`` words, and suffixes that are
  alone drop out;
* **deep**: what is left has a long common prefix.  A blind trie orders each
  group: it stores branching depths and branching words only, a suffix descends
  blindly to some leaf, one comparison with that leaf gives the depth where it
  belongs, and it is hung in there.  Reading the leaves in order gives the sorted
  suffixes with the common prefix of neighbours.  (A group of two is a trie with
  one branch: one comparison, done for all such groups together.)

Neighbours with at least ``min_words`` common words repeat the group's first
occurrence, the least ``(doc_id, position)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.anchors import ROWS, SPAN, binary, combine, covered, flat, meet, run_hashes, runs, segments, spread
from brindle.llm.runtime import fresh, materialise, named, prepare
from brindle.llm.textkernel import buffers, chunks, window_hashes, words_of

SHALLOW = 6
CODE, CHECK = 2, 4  # bytes of a word's code, and of a window's hash


def _codes(hashed: np.ndarray) -> np.ndarray:
    return hashed.view(np.uint8).reshape(-1, 8)[:, 8 - CODE :]


def _segments(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple]:
    """Segments, with their words' codes and their windows' hashes as content."""
    for batch in batches:
        for part, words in chunks(batch, "text"):
            hashed = words.hashes()
            found = segments(words, hashed, span)
            if not len(found.at):
                continue
            doc = np.searchsorted(words.first, found.at, side="right") - 1
            size = found.n + span - 1
            whole = CODE * size + CHECK * found.n
            data = np.empty(int(whole.sum()), dtype=np.uint8)
            begin = np.cumsum(whole) - whole
            data[spread(begin, CODE * size)] = _codes(hashed)[spread(found.at, size)].ravel()
            data[spread(begin + CODE * size, CHECK * found.n)] = window_hashes(hashed, span).view(np.uint8).reshape(-1, 8)[:, 8 - CHECK :][spread(found.at, found.n)].ravel()
            start = (found.at - words.first[doc]).astype(np.int32)
            yield found.key, part.column(0).to_numpy()[doc], start, found.n, binary(data, whole), run_hashes(hashed, found.at, size)


def shallow(group: np.ndarray, at: np.ndarray, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split groups of suffixes by their first ``depth`` words; returns those not alone, in order.

    ``group`` numbers the groups from 0; ``at`` is where each suffix begins in
    ``codes``.  The result is ``(rows, group)``, sorted by group.
    """
    rows = np.arange(len(group))
    for d in range(depth + 1):
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], group[order]
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        stay = ~(new & np.concatenate([new[1:], [True]])) if len(group) else new
        rows, new = rows[stay], new[stay]
        group = np.cumsum(new) - 1
        if d == depth or not len(rows):
            break
        group = (group << (8 * CODE)) | codes[at[rows] + d].astype(np.int64)
    return rows, group


class _Branch:
    """A trie's inner node: suffixes below agree on the words before ``depth``."""

    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


def blind_trie(suffixes: np.ndarray) -> tuple[list[int], list[int]]:
    """Order the rows of ``suffixes`` (words, equally many); returns it, and the common prefixes.

    ``lcp[i]`` is how many words row ``order[i]`` shares with row ``order[i - 1]``.
    Leaves are lists of equal rows.
    """
    width = suffixes.shape[1]
    words = suffixes.tolist()
    root: _Branch | list[int] = [0]
    for row in range(1, len(words)):
        word = words[row]
        node = root
        while type(node) is _Branch:  # blindly: a branch that isn't there is as good as any
            node = node.kids.get(word[node.depth]) or next(iter(node.kids.values()))
        other = words[node[0]]
        if other == word:
            node.append(row)
            continue
        same = next(i for i in range(width) if other[i] != word[i])
        above, node = None, root
        while type(node) is _Branch and node.depth < same:
            above, node = node, node.kids[word[node.depth]]
        if type(node) is _Branch and node.depth == same:
            node.kids[word[same]] = [row]
            continue
        branch = _Branch(same, {other[same]: node, word[same]: [row]})
        if above is None:
            root = branch
        else:
            above.kids[word[above.depth]] = branch
    order: list[int] = []
    lcp: list[int] = []
    stack: list = [(root, 0)]
    while stack:
        node, common = stack.pop()
        if type(node) is _Branch:
            kids = sorted(node.kids)
            stack += [(node.kids[k], node.depth if k != kids[0] else common) for k in reversed(kids)]
        else:
            order += node
            lcp += [common] + [width] * (len(node) - 1)
    return order, lcp


def deep(rows: np.ndarray, group: np.ndarray, at: np.ndarray, codes: np.ndarray, depth: int, span: int) -> np.ndarray:
    """Sort the groups that :func:`shallow` left; returns a class for each of ``rows``.

    Suffixes of one class have ``span`` words in common.
    """
    out = np.arange(len(rows))
    if not len(rows):
        return out
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(edge, len(group)))
    reach = np.arange(depth, span)
    pairs = edge[size == 2]
    for s in range(0, len(pairs), 20_000):
        a = pairs[s : s + 20_000]
        equal = (codes[at[rows[a]][:, None] + reach] == codes[at[rows[a + 1]][:, None] + reach]).all(axis=1)
        out[a[equal] + 1] = a[equal]
    for e, n in zip(edge[size > 2], size[size > 2], strict=True):
        order, lcp = blind_trie(codes[at[rows[e : e + n]][:, None] + reach])
        leader = e + order[0]
        for x, common in zip(order[1:], lcp[1:], strict=True):
            if common < span - depth:
                leader = e + x
            out[e + x] = out[leader]
    return out


def sort_piece(table: pa.Table, span: int) -> pa.RecordBatch:
    """The suffixes of some whole lists that repeat an earlier one, as runs."""
    none = np.zeros(0, dtype=np.int64)
    if not table.num_rows:
        return runs(none, none, none, none)
    key = table.column(0).to_numpy()
    doc, start = table.column(1).to_numpy(), table.column(2).to_numpy().astype(np.int64)
    content = table.column(3).combine_chunks()
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])])
    if again.any():  # repeated rows; of several texts with one id the parts that differ stay
        keep, seen = np.ones(len(key), dtype=bool), {}
        for i in np.flatnonzero(again | np.append(again[1:], False)):
            keep[i] = seen.setdefault((key[i], doc[i], start[i], content[int(i)].as_py()), i) == i
        key, doc, start, content = key[keep], doc[keep], start[keep], content.filter(pa.array(keep))
    codes_of = content.dictionary_encode().indices.to_numpy()
    data, edge = flat(content)
    n = (np.diff(edge) - CODE * (span - 1)) // (CODE + CHECK)
    wide = np.zeros((int((n + span - 1).sum()), 4), dtype=np.uint8)
    wide[:, :CODE] = data[spread(edge[:-1], CODE * (n + span - 1))].reshape(-1, CODE)
    codes = wide.view(np.uint32).ravel()
    checks = np.ascontiguousarray(data[spread(edge[:-1] + CODE * (n + span - 1), CHECK * n)]).view(np.uint32)
    first_code, first_check = np.cumsum(n + span - 1) - (n + span - 1), np.cumsum(n) - n
    owner = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    # equal segments: rows come sorted by document and start, so the first is the one to refer to
    _, first, copy = np.unique(owner * (codes_of.max() + 1) + codes_of, return_index=True, return_inverse=True)
    lead = first[copy]
    same = np.flatnonzero(lead != np.arange(len(key)))
    got = [(np.repeat(doc[same], n[same]), spread(start[same], n[same]), np.repeat(doc[lead[same]], n[same]), spread(start[lead[same]], n[same]))]
    # sort the suffixes of what is left, where a list has more than one segment left
    left = np.sort(first)
    left = left[np.bincount(owner[left], minlength=owner[-1] + 1)[owner[left]] > 1]
    if len(left):
        seg = np.repeat(left, n[left])
        word = spread(np.zeros(len(left), dtype=np.int64), n[left])
        at = first_code[seg] + word
        depth = min(SHALLOW, span)
        rows, group = shallow(owner[seg], at, codes, depth)
        kind = deep(rows, group, at, codes, depth, span)
        check = checks[(first_check[seg] + word)[rows]]
        seg, place = seg[rows], (start[seg] + word)[rows]
        order = np.lexsort((place, doc[seg], check, kind))
        kind, check, seg, place = kind[order], check[order], seg[order], place[order]
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (check[1:] != check[:-1])]) if len(kind) else np.zeros(0, dtype=bool)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(kind) else none
        hit = ~new & ~((doc[seg] == doc[seg[head]]) & (place == place[head]))
        got.append((doc[seg[hit]], place[hit], doc[seg[head[hit]]], place[head[hit]]))
    return runs(*(np.concatenate(x) for x in zip(*got, strict=True)))


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = SPAN) -> DataFrame:
    """``(doc_id, start_word, end_word, ref_id, ref_start)``: passages that occurred before.

    Words ``start_word .. end_word - 1`` of ``doc_id`` repeat those of ``ref_id``
    from ``ref_start`` on.  Words are runs of characters other than ASCII white
    space; case and punctuation count.  A passage's first occurrence has no row.
    Null and short texts have none, rows without an id are left out, and rows
    that repeat a whole row (same id, same text) count once.
    """
    prepare(docs.sparkSession)
    rows = named(docs, id_col, text_col).mapInArrow(lambda it: combine(_segments(it, min_words)), ROWS)
    return meet(rows, lambda table: sort_piece(table, min_words), min_words)


def _cut(batches: Iterator[pa.RecordBatch], text: str, count: str | None) -> Iterator[pa.RecordBatch]:
    """Take the spans in the last column out of the texts; a text with no word left goes."""
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index(text)).to_pylist()
        spans = batch.column(len(names) - 1).to_pylist()
        keep = np.ones(len(texts), dtype=bool)
        for i, found in enumerate(spans):
            if not found:
                continue
            data, base = buffers(pa.array([texts[i]]))
            words = words_of(data, base)
            raw, parts, at = data.tobytes(), [], 0
            for span in found:
                parts.append(raw[at : words.start[span["start_word"]]])
                at = words.start[span["end_word"]] if span["end_word"] < len(words.start) else len(raw)
            texts[i] = b"".join([*parts, raw[at:]]).decode()
            keep[i] = bool(texts[i].strip())
        arrays = list(batch.columns[:-1])
        arrays[names.index(text)] = pa.array(texts, pa.string())
        if count in names[:-1]:
            where = names.index(count)
            hit = [bool(x) for x in spans]
            sizes = [len(x) if h else y for x, h, y in zip(texts, hit, arrays[where].to_pylist(), strict=True)]
            arrays[where] = pa.array(sizes, arrays[where].type)
        yield pa.RecordBatch.from_arrays(arrays, names[:-1]).filter(pa.array(keep))


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", min_words: int = SPAN) -> DataFrame:
    """``docs`` with repeated passages cut from all places but the first; all columns stay.

    ``count_col``, if there, gets the new number of characters of texts that were
    cut.  A document of which nothing is left goes; others, empty ones and those
    without an id among them, stay as they are.
    """
    spans = materialise(covered(repeats(docs, id_col=id_col, text_col=text_col, min_words=min_words)))
    key, found = fresh(docs, "cut_id"), fresh(docs, "cut_spans")
    spans = spans.select(F.col("doc_id").alias(key), F.col("spans").alias(found))
    marked = docs.join(spans, F.col(f"`{id_col}`").cast("bigint") == F.col(f"`{key}`"), "left").drop(key)
    return marked.mapInArrow(lambda it: _cut(it, text_col, count_col), docs.schema)
