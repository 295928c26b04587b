"""URL filters: pattern rules indexed by their rarest literal token.

Rules are in the syntax of ad-block lists, a line each:

    ||host^        the host, or any host below it
    /part/         anywhere in the URL
    |https://..    from the beginning on;  ``..|`` up to the end
    ``*``          anything, ``^`` a separator (not a letter, digit, ``_ - . %``) or the end
    @@rule         an exception: URLs that match it are never blocked

A rule's *tokens* are the runs of letters and digits in it that a URL it matches
has as whole tokens too.  Each rule is indexed under that token of it which the
fewest URLs have (counted over all of them); URL tokens fetch candidate rules by
a join, and only candidates run their regular expression.  Rules without a token
are candidates for every URL.

All of it is DataFrame operations; a URL is read once for the counts and once
for the matches, and only matches are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.runtime import materialise, prepare

RULES = [
    "||spam-farm.example.org^",
    "||cheap-pills.example.com^",
    "||casino*.example.net^",
    "||ads.*^",
    "/adserver/",
    "/banner*.gif|",
    "utm_source=feed",
    "&ref=x|",
    "|http://blog.*/fr/",
    "||tionble.example.org/de/",
    "/en/7^",
    "^page=2&",
    ".html|",
    "||example.net/es/*#top",
    "@@||www.",
    "@@/en/1",
    "@@||m.*.example.com^",
]
#: Longer rule lists are joined by a shuffle, not sent to all executors.
MAX_SENT = 200_000
_TOKEN = re.compile(r"[a-z0-9]+")


def parse(rule: str) -> tuple[str, str, list[str]]:
    """Action, regular expression (in the syntax common to Java, RE2 and Python) and whole tokens of a rule."""
    action, text = ("allow", rule[2:]) if rule.startswith("@@") else ("block", rule)
    text = text.lower()
    domain, begin, end = text.startswith("||"), text.startswith("|"), text.endswith("|") and len(text) > 1
    body = text[2 if domain else 1 if begin else 0 : -1 if end else None]
    body = re.sub(r"\*+", "*", body)
    parts = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}
    pattern = "".join(parts.get(c, re.sub(r"([^a-z0-9_/:=&%#-])", r"\\\1", c)) for c in body)
    pattern = (r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if domain else "^" if begin else "") + pattern + ("$" if end else "")
    tokens = []
    for found in _TOKEN.finditer(body):
        left, right = body[found.start() - 1 : found.start()], body[found.end() : found.end() + 1]
        whole_left = left != "*" if found.start() else domain or begin
        whole_right = right != "*" if found.end() < len(body) else end
        if whole_left and whole_right:
            tokens.append(found[0])
    return action, pattern, sorted(set(tokens))


KINDS = pa.schema([("rule", pa.string()), ("action", pa.string()), ("pattern", pa.string()), ("tokens", pa.list_(pa.string()))])


def _is_rule(text: str | None) -> bool:
    return bool(text and text.strip("|*^@ "))


def _parsed(rules: list[str]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(KINDS.names, (r, *parse(r)), strict=True)) for r in rules if _is_rule(r)], KINDS)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _parsed(batch.column(0).to_pylist()).to_batches()


def match(pages: DataFrame, rules: list[str] | DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", rule_col: str = "rule") -> DataFrame:
    """``(page_id, url, blocked, block_rules, allow_rules)`` for every row that a rule matches.

    A URL is compared in lower case.  It is blocked if a blocking rule matches and
    no exception does; the last two columns count the rules.  Rules that repeat
    count once; ``rules`` is a list of them, or a table with a column ``rule_col``, of any length; null
    and empty rules are left out.  Null URLs and ids match nothing; rows with equal id and URL are
    one row of the result; an empty rule list gives an empty result.
    """
    spark: SparkSession = pages.sparkSession
    if isinstance(rules, DataFrame):
        prepare(spark)
        texts = rules.select(F.col(f"`{rule_col}`").cast("string").alias("rule")).distinct()
        rule_rows = materialise(texts.mapInArrow(_parse_batches, "rule string, action string, pattern string, tokens array<string>"))
        number, bare = rule_rows.agg(F.count("*"), F.count_if(F.size("tokens") == 0)).first()
    else:
        parsed = _parsed(list(dict.fromkeys(RULES if rules is None else rules)))
        number, bare = len(parsed), sum(not x for x in parsed.column("tokens").to_pylist())
        rule_rows = spark.createDataFrame(parsed)  # a local relation, without a job
    small = F.broadcast if number <= MAX_SENT else (lambda df: df)
    urls = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).where("page_id is not null and url is not null")
    found_tokens = F.split(F.lower("url"), "[^a-z0-9]+")
    if bare:  # the empty token stands for rules without one
        found_tokens = F.concat(F.array(F.lit("")), found_tokens)
    tokens = urls.select("page_id", "url", F.explode(F.array_distinct(found_tokens)).alias("token"))
    candidates = rule_rows.select("rule", F.explode("tokens").alias("token"))
    # how many URLs have each token of a rule; tokens of no rule are dropped before the shuffle
    counts = tokens.join(small(candidates.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = candidates.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    index = rule_rows.join(rarest, "rule", "left").select("rule", "action", "pattern", F.coalesce("best.token", F.lit("")).alias("token"))
    hits = tokens.join(small(index), "token").where("regexp_like(lower(url), pattern)")
    block, allow = F.count_if(F.col("action") == "block"), F.count_if(F.col("action") == "allow")
    found = hits.select("page_id", "url", "rule", "action").distinct().groupBy("page_id", "url").agg(block.alias("block_rules"), allow.alias("allow_rules"))
    return found.select("page_id", "url", F.expr("block_rules > 0 and allow_rules = 0").alias("blocked"), "block_rules", "allow_rules")


def rules_sql(rules: list[str] | None = None) -> str:
    """The same in DuckDB's SQL, every rule run on every URL of ``pages``."""
    parsed = [parse(r)[:2] for r in dict.fromkeys(RULES if rules is None else rules) if _is_rule(r)]
    tests = {x: " + ".join(f"(regexp_matches(lower(url), '{p}'))::BIGINT" for a, p in parsed if a == x) or "0" for x in ("block", "allow")}
    return f"""select page_id, url, block_rules > 0 and allow_rules = 0 as blocked, block_rules, allow_rules from (
select distinct page_id, url, {tests["block"]} as block_rules, {tests["allow"]} as allow_rules from pages where page_id is not null and url is not null
) where block_rules + allow_rules > 0"""
