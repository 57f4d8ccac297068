import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves, to clash with.
CLASH = ["score", "kept", "held_out", "part", "node", "bucket", "length", "start", "piece", "n_words", "spans", "grade", "label"]


def word(rng):
    return "".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 8)))


@pytest.fixture(scope="session")
def texts():
    """Documents with every odd case: nulls, empty and blank texts, one very long word and text, copies and near copies, repeated rows."""
    rng = random.Random(3)
    vocabulary = [word(rng) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, prose(rng.randint(1, 200))) for k in range(40)]
    base = prose(150)
    rows += [(100, base), (101, base), (102, base.upper()), (103, base.replace(" ", "\n", 4))]
    near = base.split()
    for k in range(6):
        own = list(near)
        own[rng.randrange(len(own))] = "changed"
        rows.append((110 + k, " ".join(own)))
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "One"), (205, "#$%& 123 ||"), (206, "x" * 50_000), (207, prose(20_000)), (None, "no id here"), (None, None)]
    rows += [(300, "the same row"), (300, "the same row"), (301, base), (301, prose(30))]
    return [(k, t, rng.choice(["en", "de", None]), None if rng.random() < 0.2 else "s", None if t is None else len(t)) for k, t in rows]


@pytest.fixture(scope="session")
def odd(spark, texts):
    """The documents as a table with more columns, whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(texts, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
