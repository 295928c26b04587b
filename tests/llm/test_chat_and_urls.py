import re

import duckdb

from brindle.llm import chat, queries, urlfilter


def test_spans_rebuild_the_rendering(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = chat.format_turns(turns, {"bracketed": chat.bracketed}).collect()
    said = {}
    for r in turns.orderBy("turn").collect():
        said.setdefault(r.conv_id, []).append({"role": r.role, "content": r.text})
    for conv, messages in said.items():
        whole = chat.bracketed(messages)
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        assert len(mine) == len(messages)
        for r in mine:
            assert whole[r.span_start : r.span_end] == r.piece
        if not any(r.rewrites for r in mine):
            assert "".join(r.piece for r in mine) == whole


def test_rewriting_templates_are_told_apart():
    said = [{"role": "user", "content": "q1"}, {"role": "assistant", "content": "a1"}, {"role": "user", "content": "q2"}, {"role": "assistant", "content": "a2"}]
    text, spans = chat.turn_spans(said, chat.last_answer)
    assert [r for _, _, r in spans] == [False, False, False, True]
    assert text == chat.last_answer(said)
    parted = text.index("...")
    assert all(e <= parted for _, e, _ in spans[:-1]) and spans[-1][:2] == (parted, len(text))
    assert not any(r for *_, r in chat.turn_spans(said, chat.chatml)[1])
    late = [said[0], said[1], {"role": "system", "content": "s"}]
    assert [r for *_, r in chat.turn_spans(late, chat.bracketed)[1]] == [False, False, True]
    assert chat.turn_spans([], chat.chatml) == ("", [])


def test_awkward_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, "user", "first"), (1, 1, None, None), (None, 0, "user", "x"), (2, 5, "user", ""), (3, 1, "user", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as said", "2 as position", "3 as turns")
    got = sorted(chat.format_turns(df, {"chatml": chat.chatml}).collect(), key=lambda r: (r.conv_id, r.position))
    assert chat.format_turns(df).count() == 3 * len(got)
    assert [(r.conv_id, r.position, r.turn) for r in got] == [(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 0, 5), (3, 0, 1)]
    assert got[3].piece == "<|im_start|>\n<|im_end|>\n"
    assert chat.format_turns(df.where("false")).count() == 0


URLS = ["http://ads.x.org/a", "https://sub.ads.net/", "http://x.org/ads.net", "HTTP://X.org/Banner7.GIF", "http://x.org/banner.gif?y", "https://www.casino12.example.net/q", "http://spam-farm.example.org.evil.com/", "http://spam-farm.example.org", "no url", "", "http://x.org/?utm_source=feed&y=1", "http://x.org/p?q=1&ref=x"]


def brute(rules, urls):
    out = {}
    for i, u in urls:
        hit = [urlfilter.parse(r)[0] for r in rules if re.search(urlfilter.parse(r)[1], u.lower())]
        if hit:
            out[i, u] = (hit.count("block") > 0 and not hit.count("allow"), hit.count("block"), hit.count("allow"))
    return out


def test_candidates_lose_no_match(spark):
    rules = [*urlfilter.RULES, "*", "||example.net^", "gif|", "^", "ads", "|http:", "@@ref=x|"]
    rules = [r for r in rules if r.strip("|*^@ ")]
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    got = {(r.page_id, r.url): (r.blocked, r.block_rules, r.allow_rules) for r in urlfilter.match(pages, rules).collect()}
    assert got == brute(rules, list(enumerate(URLS)))


def test_rules_from_a_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rules = spark.createDataFrame([(r, 1) for r in [*urlfilter.RULES, None, "", "||", urlfilter.RULES[0]]], "rule string, token int")
    assert sorted(urlfilter.match(pages, rules).collect()) == sorted(urlfilter.match(pages).collect())
    assert urlfilter.match(pages, rules.where("false")).count() == 0


def test_long_rule_lists_are_joined_by_shuffle(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    sent = sorted(urlfilter.match(pages).collect())
    monkeypatch.setattr(urlfilter, "MAX_SENT", 0)
    assert sorted(urlfilter.match(pages).collect()) == sent and sent


def test_awkward_pages(spark):
    rows = [(1, "http://ads.x.org/"), (1, "http://ads.x.org/"), (2, None), (None, "http://ads.x.org/"), (3, "http://ads.x.org/" + "y/" * 50_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "1 as token", "2 as rule", "3 as n")
    assert {(r.page_id, r.blocked) for r in urlfilter.match(df).collect()} == {(1, True), (3, True)}
    assert urlfilter.match(df).count() == 2
    assert urlfilter.match(df, []).count() == 0
    assert urlfilter.match(df.where("false")).count() == 0


def test_sql(spark, sf, tmp_path):
    con = duckdb.connect()
    # texts of dots, which the template that shrinks answers can't tell from its mark, and empty ones
    said = [(10**6 + i, n, role, text) for i, texts in enumerate([["", ".", "..", "..."], ["....", "...x", "<", None], [".</assistant>", "", ".", "a"]]) for n, (role, text) in enumerate(zip(["user", "assistant", "assistant", "assistant"], texts, strict=True))]
    folder = tmp_path / "tables"
    spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionAll(spark.createDataFrame(said, "conv_id bigint, turn int, role string, text string")).write.parquet(f"{folder}/conversations.parquet")
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(f"{folder}/pages.parquet")
    for name in ("pages", "conversations"):
        con.sql(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, str(folder))
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
