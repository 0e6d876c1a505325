"""Tables that every operator must take, and plain definitions."""

import random

WHITE = " \t\n\x0b\x0c\r"

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = "score double, kept boolean, label int, key string, rank int, n int, block int, taken int, __n int, position int, did bigint, hub int"


def words(text):
    out, own = [], ""
    for c in text or "":
        if c in WHITE:
            if own:
                out.append(own)
            own = ""
        else:
            own += c
    return out + [own] if own else out


def sentence(r, n):
    return " ".join(r.choice(["the", "and", "of"]) if r.random() < 0.3 else "".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def hard_rows(seed=5):
    """Nulls in every column, empty and very long texts, odd white space, exact and near copies, repeated rows."""
    r = random.Random(seed)
    base = sentence(r, 120)
    parts = base.split()
    near = " ".join(parts[:60] + ["changed"] + parts[61:])
    shared = sentence(r, 30)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, base.upper(), "fr", None, None),
        (5, None, "en", "a", None), (6, "", None, "a", 0), (7, " \n\t ", "de", "b", 4), (8, "one", "en", "c", 3),
        (9, sentence(r, 40) + " " + shared, "en", "c", 1), (10, shared + "\n" + sentence(r, 40), "en", "c", 1),
        (11, " " + sentence(r, 25).replace(" ", "  ") + "\x1f x   \U0001f600", "xx", "d", 1),
        (12, sentence(r, 9000), "en", "big", 1), (13, "loop the loop " * 40, "en", "a", 1),
        (14, "### $$$ *** %%% " * 20, "en", "a", 1), (None, sentence(r, 30), "en", "a", 1), (None, None, None, None, None),
        (15, base, None, "e", 1), (15, base, None, "e", 1), (16, sentence(r, 50), "en", "e", 1), (16, sentence(r, 60), "es", "e", 1),
    ]
    return rows + [(20 + i, sentence(r, r.randint(1, 80)), r.choice(["en", "fr", "de"]), r.choice("abc"), 1) for i in range(20)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.selectExpr("*", *(f"cast(null as {kind}) as {name}" for name, kind in (x.split() for x in EXTRA.split(", "))))
