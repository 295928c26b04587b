import random
import re

from brindle.llm import decontaminate
from tests.llm.common import awkward, documents, empty

ITEM = "If Tom buys 5 apples for 3 dollars each and Tom sells 2 apples, how much money does Tom have left at the end?"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id bigint, text string")


def found(spark, texts, *items):
    got = decontaminate.leaks(documents(spark, list(enumerate(texts))), bench(spark, *items))
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def test_verbatim_and_altered_items(spark):
    got = found(
        spark,
        [
            f"before it. {ITEM} And after",
            "So: if Mary Ann buys 7 apples for 4 euros each and Mary Ann sells 6 apples, how much money does Mary Ann have left at the end? ok",
            ITEM.upper(),
            ITEM.replace(" ", "\n"),
            "If Mary buys 7 apples for 4 euros each and John sells 7 apples, how much money does Tom have left at the end?",  # slots are crossed
            "If Tom buys a car, how much money does he have?",
        ],
        ITEM,
        "two words",
    )
    assert {k for k in got} == {(0, 0), (1, 0), (2, 0), (3, 0)}
    assert got[0, 0].altered == 0 and got[1, 0].altered == 5 and got[0, 0].matched == got[0, 0].windows


def test_short_items_and_excerpts(spark):
    short = "what is the largest city there"
    long = " ".join(f"word{i}a" for i in range(200)).replace("word", "wo ")
    got = found(spark, [f"tell me {short} please", "what is the largest", " ".join(long.split()[100:160])], short, long)
    assert set(got) == {(0, 0), (2, 1)}


def test_items_of_numbers_and_very_short_ones(spark):
    items = ["What is 12 times 7 plus 5?", "What is 345 times 27?", "Compute 1 + 2 + 3 + 4 km, 5 - 6 Paris.", "two words", "..."]
    texts = [f"before it. {i} And after" for i in items] + ["what is 12 TIMES 7, plus 5", "What is 13 times 7 plus 5? What is 345 times 28? Compute 1 + 2 + 3 + 4 km, 5 - 7 Paris. two other words"]
    assert set(found(spark, texts, *items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 0)}


def test_the_numbers_of_a_long_item(spark):
    """Of the words only the numbers are copied; a template without literals can't tell them."""
    numbers = " ".join(str(i * i + 7) for i in range(40))
    item = f"Add all of these numbers and say what their sum would be: {numbers}"
    got = found(spark, [numbers, " ".join(str(i) for i in range(300))], item)
    assert set(got) == {(0, 0)}


def test_changed_names_at_the_beginning_of_sentences_and_lines(spark):
    item = "A farmer has 12 cows. Tom buys 3 more cows. How many cows are there now?"
    long = "Tom has 5 red apples in a bag. Tom gives 2 of them to his friend. Tom then finds 4 more apples. Tom eats one of those. Tom asks how many are left."
    inside = "At the market Tom meets Ann, then Tom pays Ann for eggs, and Ann thanks Tom with bread"
    wrapped = "At the market\nMary meets\nBob, then\nMary pays\nBob for eggs, and\nBob thanks\nMary with bread"
    texts = [
        item.replace("Tom", "Mary"),
        item.replace("Tom", "Mary").replace("12", "15").replace(". ", ".\n"),
        long.replace("Tom", "Mary"),
        wrapped,
        wrapped.replace("Mary pays", "Bob pays").replace("Bob for", "Mary for"),  # slots are crossed
        "A farmer sells 12 cows. Mary likes 3 more horses. How many cows did he have?",
    ]
    got = found(spark, texts, item, long, inside)
    assert set(got) == {(0, 0), (1, 0), (2, 1), (3, 2)}
    assert got[0, 0].altered == 1 and got[1, 0].altered == 2 and got[2, 1].altered == 1 and got[3, 2].altered == 2


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    tokens = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    listed = {r.item_id: tokens(r.text) for r in items.collect()}
    want = set()
    for r in docs.collect():
        text = " ".join(tokens(r.text))
        want |= {(r.doc_id, i) for i, w in listed.items() if f" {' '.join(w[1:-1])} " in f" {text} "}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == want and want


def templates(text):
    """The four templates of a text, as lists of (token, value): a token is a word or a type."""
    words = list(re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text or ""))
    upper = lambda c: "A" <= c <= "Z" or ("\u00c0" <= c <= "\u00de" and c != "\u00d7")
    kinds, last = [], None
    for m in words:
        w = "".join(c.lower() if upper(c) else c for c in m[0])
        stop = last is None or any(c in "\n!.:?" for c in text[last : m.start()])
        name = len(m[0]) > 1 and upper(m[0][0]) and not upper(m[0][1])
        plain = "<number>" if w[0] in "0123456789" else "<unit>" if w in decontaminate.UNITS else None
        kinds.append((w, plain or ("<name>" if name and not stop else None), plain, plain or ("<name>" if name else None), None))
        last = m.end()
    out = []
    for t in range(1, 5):
        made = []
        for k in kinds:
            if k[t] and made and made[-1][0] == k[t]:
                made[-1] = (k[t], made[-1][1] + (k[0],))
            else:
                made.append((k[t] or k[0], (k[0],) if k[t] else None))
        out.append(made)
    return out


def windows(template, width):
    return [(at, tuple(t for t, _ in template[at : at + width]), tuple(v for _, v in template[at : at + width] if v)) for at in range(len(template) - width + 1)]


def brute(docs, items, window=10, min_literals=5, min_tokens=6, min_share=0.3, min_run=20):
    index = []
    for item, text in items:
        made, whole = templates(text), False
        for t, template in enumerate(made):
            if len(template) < min(window, min_tokens) and t < 3 or (t == 3 and (whole or not template)):
                continue
            width = min(len(template), window)
            listed = windows(template, width)
            if t < 3:
                fits = [w for w in listed if sum(not k.startswith("<") for k in w[1]) >= min(min_literals, width)]
                whole |= t == 1 and len(fits) == len(listed) > 0 and len(template) == len(made[3])
                listed = fits
            index.append((item, t, width, listed))
    out = set()
    for doc, text in docs:
        best = {}
        made = templates(text)
        places = {}
        for t, width in {(t, w) for _, t, w, _ in index}:
            for at, key, values in windows(made[t], width):
                places.setdefault((t, width, key), []).append((at, values))
        for item, t, width, listed in index:
            lines = {}
            for at, key, values in listed:
                for there, others in places.get((t, width, key), ()):
                    lines.setdefault(there - at, {}).setdefault(at, set()).add(frozenset(zip(values, others, strict=True)))
            for line in lines.values():
                kept, altered = decontaminate.consistent(line)
                enough = 2 * kept > len(line) and (kept >= min_share * len(listed) or kept >= min_run)
                best[item] = max(best.get(item, (False, 0, 0, 0)), (enough, kept, -altered, len(listed)))
        out |= {(doc, item, n, of, -altered) for item, (enough, n, altered, of) in best.items() if enough}
    return out


def test_templates_and_slots_against_brute_force(spark, sf):
    """On the table, and on altered copies of its items and made-up ones of numbers and names."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    listed = [(r.item_id, r.text) for r in items.collect()]
    made = ["What comes next: 2, 4, 8, .. 2048?", "Add 3 kg 5 g to 7 kg 9 g then 11 kg 13 g and 15 kg 17 g", "Who wrote Hamlet in 1601", ITEM, "Élise a 12 pommes. Zoé prend 3 pommes. Combien de pommes Élise a-t-elle encore?"]
    listed += [(10**6 + i, t) for i, t in enumerate(made)]
    for n in range(150):
        item = rng.choice(listed)[1].split()
        for _ in range(rng.randint(0, 4)):
            item[rng.randrange(len(item))] = rng.choice(["Mary", "Jörg", "17", "3.5", "kg", "other", "of"])
        text = " ".join([rng.choice(rows)[1][:200], *item[rng.randint(0, 3) : len(item) - rng.randint(0, 3)], "end."])
        rows.append((10**6 + n, text.replace(". ", ".\n") if rng.random() < 0.3 else text))
    frame = lambda r, c: spark.createDataFrame(r, f"{c} bigint, text string")
    found = decontaminate.leaks(frame(rows, "doc_id"), frame(listed, "item_id")).collect()
    assert {tuple(r) for r in found} == brute(rows, listed)
    assert sum(r.altered > 0 for r in found) > 5


def test_a_wrong_window_does_not_reject_the_others():
    windows = {0: {frozenset({(1, 9)})}, **{i: {frozenset({(1, 2)})} for i in range(1, 6)}}
    assert decontaminate.consistent(windows) == (5, 1)
    assert decontaminate.consistent({3: {frozenset({(1, 2), (3, 2)})}}) == (0, 0)
    assert decontaminate.consistent({}) == (0, 0) and decontaminate.consistent({1: {frozenset()}}) == (1, 0)


def test_join_by_shuffle_finds_the_same(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    sent = sorted(decontaminate.leaks(docs, items).collect())
    monkeypatch.setattr(decontaminate, "MAX_SENT", 0)
    assert sorted(decontaminate.leaks(docs, items).collect()) == sent


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "naïve ünïcode ☃ " * 8), (1, "naïve ünïcode ☃ " * 8), (2, None), (None, ITEM), (3, "")], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {9}
    kept = decontaminate.keep_clean(docs, items)
    assert kept.schema == docs.schema and kept.count() == docs.count() - 2
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.leaks(docs, items.where("false")).count() == 0
