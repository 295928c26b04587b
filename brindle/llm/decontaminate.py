"""Benchmark decontamination by template canonicalisation.

A text becomes a *template*: its tokens (runs of letters and digits, case
folded) with numbers, names and units replaced by typed placeholders; a run of
placeholders of one type is one slot.  A name is a token with a capital and then a
small letter that doesn't begin a sentence; a number begins with a digit; units are a fixed list.  As
capitals get lost, a second template leaves names as the words they are.  As names
begin sentences and lines too, in a third every token with such a capital is a name,
wherever it stands; so lines may be broken in other places.

Windows of ``window`` template tokens of every benchmark item are hash-joined
with those of every document.  Hits of one document and item on one diagonal
(document position minus item position) must agree about their slots: an item's
value stands for one document value and the other way round, those that most windows of the
diagonal have (of as many, the least hash); windows with another are left out.  So an item asked
again with other numbers or names is found, and a text that merely has the same
shape with its slots crossed is not.

A window of a template has ``min_literals`` literals at least, and a template
``min_tokens`` tokens; fewer can't be told from ordinary text.  Items that this
or runs of placeholders leave with less than all their windows (questions of
numbers, very short ones) have their words as a fourth, *exact* template: those
are found verbatim, apart from case and punctuation.

An item leaks into a document if consistent windows of one template make up
``min_share`` of the item's windows there, or there are ``min_run`` of them, and more of the
diagonal's windows are consistent than not.  Items
shorter than a window are one window of their own length, so an item of one word
leaks into every document with that word; only items without words match nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.anchors import binary, spread
from brindle.llm.runtime import materialise, named, prepare, without
from brindle.llm.textkernel import CHUNK_BYTES, U64, Words, buffers, fold, mix, window_hashes, window_ok, words_of

WINDOW, MIN_LITERALS, MIN_TOKENS = 10, 5, 6
MIN_SHARE, MIN_RUN = 0.3, 20
#: Benchmark windows beyond this number are joined by a shuffle, not sent to all executors.
MAX_SENT = 1_000_000

UNITS = """mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer
kilometers centimetre centimetres centimeter centimeters g kg mg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons
tonne tonnes l ml litre litres liter liters gallon gallons pint pints cup cups s sec secs second seconds min mins minute minutes h hr hrs hour
hours day days week weeks month months year years usd eur gbp dollar dollars cent cents euro euros percent pct degree degrees celsius
fahrenheit kelvin mph kmh kph hz khz mhz ghz w kw watt watts v volt volts j joule joules n newton newtons pa bar kb mb gb tb byte bytes""".split()

_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 58, 63]] = True
#: The templates: typed slots, names left as words, all words with a capital as names, and every word as it is.
TYPED, PLAIN, CAPITAL, EXACT = range(4)
TEMPLATE_BITS = 20  # the template of a window is kept above its width
SLOT = np.dtype([("at", "u1"), ("value", "<u8")])
_NUMBER, _NAME, _UNIT = 1, 2, 3


class _Members:
    """Membership of hashes in a set, most strangers told by one look-up."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.bits = max(16, min(24, int(len(hashes) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[hashes >> U64(64 - self.bits)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of members."""
        maybe = np.flatnonzero(self.seen[hashes >> U64(64 - self.bits)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0]
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == hashes[maybe]]


def _hash_words(words: list[str]) -> np.ndarray:
    data, base = buffers(pa.array(words))
    return words_of(data, base).hashes()


_units = _Members(_hash_words(UNITS))


@dataclass
class Template:
    """Template tokens of some texts: ``token`` hashes, ``kind`` (0: literal), slot ``value``; ``first`` as in Words."""

    token: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    first: np.ndarray


def canonical(data: np.ndarray, base: np.ndarray, templates: list[int]) -> list[Template]:
    """The listed templates of some texts."""
    folded = fold(data)
    words: Words = words_of(folded, base)
    if not len(words.start):
        none = np.zeros(0, dtype=U64)
        return [Template(none, np.zeros(0, np.int8), none, words.first)] * len(templates)
    hashed = words.hashes()
    lead = data[words.start]
    kind = np.zeros(len(hashed), dtype=np.int8)
    stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int32)])
    after_stop = np.ones(len(hashed), dtype=bool)
    after_stop[1:] = stops[words.start[1:]] > stops[words.end[:-1]]
    head = words.first[:-1][words.counts > 0]
    after_stop[head] = True
    # the first letter is a capital and the second isn't
    changed = folded != data
    wide = np.minimum(lead >> 7, 1).astype(np.int64)  # a two-byte letter's case shows in its second byte
    second = words.start + 1 + wide
    inside = second < words.end
    second = np.where(inside, second, words.start)
    accented = (data[second] == 0xC3) & changed[np.minimum(second + 1, len(data) - 1)]
    capital = changed[np.minimum(words.start + wide, len(data) - 1)] & inside & ~changed[second] & ~accented
    kind[_units.of(hashed)] = _UNIT
    kind[(lead >= 48) & (lead <= 57)] = _NUMBER
    kinds = {TYPED: np.where(capital & ~after_stop & (kind == 0), _NAME, kind), PLAIN: kind, CAPITAL: np.where(capital & (kind == 0), _NAME, kind), EXACT: np.zeros_like(kind)}
    return [_template(hashed, kinds[t], words.first, head) for t in templates]


def _template(hashed: np.ndarray, kind: np.ndarray, first: np.ndarray, head: np.ndarray) -> Template:
    """Runs of one placeholder become one slot; ``head`` are the texts' first words."""
    same = np.zeros(len(hashed), dtype=bool)
    same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] > 0)
    same[head] = False
    keep = np.flatnonzero(~same)
    place = np.arange(len(hashed)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(hashed))))
    value = np.add.reduceat(mix(hashed + place.astype(U64)), keep)
    kind = kind[keep]
    token = np.where(kind > 0, mix(kind.astype(U64) + U64(977)), hashed[keep])
    return Template(token, kind, value, np.searchsorted(keep, first))


def _slots(found: Template, at: np.ndarray, width: int) -> pa.Array:
    """The slots of windows, as packed (place, value) pairs."""
    at_slot = np.flatnonzero(found.kind > 0)
    lo, hi = np.searchsorted(at_slot, at), np.searchsorted(at_slot, at + width)
    n = hi - lo
    rows = at_slot[spread(lo, n)] if len(at) else at_slot[:0]
    packed = np.empty(len(rows), dtype=SLOT)
    packed["at"], packed["value"] = rows - np.repeat(at, n), found.value[rows]
    return binary(packed.view(np.uint8), n * SLOT.itemsize)


def _texts(batch: pa.RecordBatch, templates: list[int]) -> Iterator[tuple[pa.RecordBatch, list[Template]]]:
    """Parts of the batch with the listed templates of their texts."""
    data, base = buffers(batch.column(1))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(base, base[at] + CHUNK_BYTES, side="right")) - 1)
        part = base[at : to + 1]
        yield batch.slice(at, to - at), canonical(data[part[0] : part[-1]], part - part[0], templates)
        at = to


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, min_literals: int, min_tokens: int) -> Iterator[pa.RecordBatch]:
    templates = [TYPED, PLAIN, CAPITAL, EXACT]
    for batch in batches:
        for part, all_found in _texts(batch, templates):
            whole = np.zeros(part.num_rows, dtype=bool)  # all windows of words are in the plain template
            for template, found in zip(templates, all_found, strict=True):
                counts = np.diff(found.first)
                literal = np.concatenate([[0], np.cumsum(found.kind == 0)])
                if template == EXACT:
                    listed = (counts > 0) & ~whole
                else:
                    listed = counts >= min(window, min_tokens)
                for width in np.unique(np.minimum(counts[listed], window)):
                    hashes = window_hashes(found.token, int(width))
                    of = np.searchsorted(found.first, np.arange(len(hashes)), side="right") - 1
                    ok = window_ok(found.first, int(width)) & listed[of] & ((counts[of] == width) | (width == window))
                    if template != EXACT:
                        fits = np.bincount(of[ok], minlength=part.num_rows)
                        ok &= literal[np.arange(len(hashes)) + width] - literal[: len(hashes)] >= min(min_literals, width)
                    at = np.flatnonzero(ok)
                    of = of[at]
                    total = np.bincount(of, minlength=part.num_rows)
                    if template == PLAIN:
                        whole |= (total > 0) & (total == fits) & (counts == np.diff(all_found[-1].first))
                    arrays = [pa.array(hashes[at].view(np.int64)), pa.array(np.full(len(at), _code(template, int(width)), np.int32)), part.column(0).take(pa.array(of)), pa.array((at - found.first[of]).astype(np.int32)), pa.array(total[of].astype(np.int32)), _slots(found, at, int(width))]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "width", "item_id", "item_at", "windows", "item_slots"])


def _code(template: int, width: int) -> int:
    return template << TEMPLATE_BITS | width


def _doc_windows(batches: Iterator[pa.RecordBatch], codes: list[int], members: _Members | None) -> Iterator[pa.RecordBatch]:
    templates = sorted({c >> TEMPLATE_BITS for c in codes})
    for batch in batches:
        for part, all_found in _texts(batch, templates):
            for code in codes:
                found, width = all_found[templates.index(code >> TEMPLATE_BITS)], code & ((1 << TEMPLATE_BITS) - 1)
                hashes = window_hashes(found.token, width)
                ok = window_ok(found.first, width)
                at = np.flatnonzero(ok) if members is None else members.of(hashes)
                at = at[ok[at]]
                if len(at):
                    of = np.searchsorted(found.first, at, side="right") - 1
                    arrays = [pa.array(hashes[at].view(np.int64)), pa.array(np.full(len(at), code, np.int32)), part.column(0).take(pa.array(of)), pa.array((at - found.first[of]).astype(np.int32)), _slots(found, at, width)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "width", "doc_id", "doc_at", "doc_slots"])


def _verify(batches: Iterator[pa.RecordBatch], min_share: float, min_run: int) -> Iterator[pa.RecordBatch]:
    """Check the slots of hits that come sorted by document, item, diagonal and item position."""
    group = line = None
    windows: dict[int, set[frozenset[tuple[int, int]]]] = {}
    best = (False, 0, 0, 0)
    rows: list[tuple[int, int, int, int, int]] = []

    def end_line() -> None:
        nonlocal best
        kept, altered = consistent(windows)
        enough = 2 * kept > len(windows) and (kept >= min_share * total or kept >= min_run)
        best = max(best, (enough, kept, -altered, total))

    def end_group() -> None:
        enough, n, changed, of = best
        if enough:
            rows.append((*group, n, of, -changed))

    total = 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for doc, item, diagonal, at, of, theirs, ours in zip(*columns, strict=True):
            if (doc, item, diagonal) != line:
                if line is not None:
                    end_line()
                if (doc, item) != group:
                    if group is not None:
                        end_group()
                    group, best = (doc, item), (False, 0, 0, 0)
                line, windows = (doc, item, diagonal), {}
            total = of
            pairs = zip(np.frombuffer(theirs, SLOT)["value"].tolist(), np.frombuffer(ours, SLOT)["value"].tolist(), strict=True) if theirs else ()
            windows.setdefault(at, set()).add(frozenset(pairs))
        if len(rows) > 1000:
            yield _rows(rows)
            rows = []
    if line is not None:
        end_line()
        end_group()
    yield _rows(rows)


def consistent(windows: dict[int, set[frozenset[tuple[int, int]]]]) -> tuple[int, int]:
    """How many of a diagonal's windows agree about their slots, and how many slots have another value there.

    ``windows`` has, by place, the (item, document) values of its slots (several sets where rows share an id).
    """
    if not any(pairs for sets in windows.values() for pairs in sets):
        return len(windows), 0
    votes = Counter(p for sets in windows.values() for p in frozenset().union(*sets))
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    for x, y in sorted(votes, key=lambda p: (-votes[p], p)):
        there.setdefault(x, y)
        back.setdefault(y, x)
    fine = [next((p for p in sorted(sets, key=sorted) if all(there[x] == y and back[y] == x for x, y in p)), None) for sets in windows.values()]
    kept = [p for p in fine if p is not None]
    return len(kept), len({p for pairs in kept for p in pairs if p[0] != p[1]})


def _rows(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "matched", "windows", "altered"])


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_share: float = MIN_SHARE, min_run: int = MIN_RUN, min_literals: int = MIN_LITERALS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``(doc_id, item_id, matched, windows, altered)``: the items that leak into each document.

    ``matched`` of the item's ``windows`` in one template were found, consistently,
    on the best diagonal; ``altered`` slots had other values.  Rows without an id are left
    out; null and empty texts match nothing; rows that share an id count as one
    document (or item), so a repeated row changes nothing.
    """
    prepare(docs.sparkSession)
    items = named(benchmark, item_col, item_text_col)
    index = materialise(items.mapInArrow(lambda it: _item_windows(it, window, min_literals, min_tokens), "key bigint, width int, item_id bigint, item_at int, windows int, item_slots binary").distinct())
    codes = sorted(r.width for r in index.select("width").distinct().collect())  # at most as many for a template as a window has tokens
    number = index.select("key").distinct().count()
    sent = None
    if number <= MAX_SENT:
        keys = np.array([r.key for r in index.select("key").distinct().collect()], dtype=np.int64)
        sent = docs.sparkSession.sparkContext.broadcast(keys)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _doc_windows(batches, codes, None if sent is None else _Members(sent.value.view(U64)))

    found = named(docs, id_col, text_col).mapInArrow(hits, "key bigint, width int, doc_id bigint, doc_at int, doc_slots binary")
    both = found.join(index, ["key", "width"]).select("doc_id", "item_id", ((F.col("doc_at") - F.col("item_at")).cast("bigint") * 4 + F.shiftright("width", TEMPLATE_BITS)).alias("diagonal"), "item_at", "windows", "item_slots", "doc_slots")
    lines = both.repartition("doc_id").sortWithinPartitions("doc_id", "item_id", "diagonal", "item_at", "doc_slots")
    return lines.mapInArrow(lambda it: _verify(it, min_share, min_run), "doc_id bigint, item_id bigint, matched int, windows int, altered int")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that an item leaks into; all columns stay.

    Rows without an id, and null and empty texts, stay; all rows of an id that an item leaks into go.
    """
    return without(docs, leaks(docs, benchmark, id_col=id_col, **options).select("doc_id").distinct(), id_col)
