"""Small inputs that the tests of several operators share."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as further columns of an input.
CLASHES = ["key", "cell", "token", "spans", "start", "n", "profile", "sig", "batch", "fold", "bucket", "gone", "id", "doc_id2", "__gone", "part", "number"]


def words(text):
    return [w for w in re.split(r"[\t\n\f\r ]+", text or "") if w]


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "sun", "ba", "vo"]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    rng = random.Random(3)
    shared = prose(rng, 80)
    rows = [
        (1, shared + " " + prose(rng, 20)),
        (2, prose(rng, 30) + " " + shared),
        (2, prose(rng, 30) + " " + shared),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (None, shared),
        (None, None),
        (6, prose(rng, 30_000)),
        (7, "x" * 300_000),
        (8, "a " * 5000),
        (9, "naïve ünïcode ☃ " * 40),
        (9, "naïve ünïcode ☃ " * 40),
        (10, shared + " " + prose(rng, 20)),
    ]
    df = documents(spark, rows)
    df = df.unionAll(spark.createDataFrame([(11, "short", None, None, None)], DOCS))
    return df.selectExpr("*", *[f"cast({i} as int) as `{c}`" for i, c in enumerate(CLASHES)])


def empty(spark):
    return spark.createDataFrame([], DOCS)
