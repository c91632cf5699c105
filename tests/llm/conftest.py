import random

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for results or on the way.
CLASHING = ("id", "key", "size", "Copies", "target", "score", "fp", "fingerprint", "spans", "slice", "at", "h", "shard", "slot", "ids", "word", "SALT")


def document_rows():
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows and ties."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gämma", "δέλτα", "eps,", "zeta.", "Eta", "theta", "iota", "kappa", "x1", "42"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = said(120)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base.replace("theta", "thetas", 1), "de", "b", None),
        (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n ", "en", "c", 4), (None, said(30), "en", "c", 1),
        (None, None, "fr", "c", 2), (7, said(4000), None, "a", 9), (8, "one", "en", None, 3), (9, "two words", "en", "b", 9),
        (10, "a@b.cd called +1 (555) 555-0199\nfrom 10.0.0.1 with 4111 1111 1111 1111 é", "en", "a", 2),
        (10, "same id, other text", "en", "a", 2), (11, base, "en", "a", 5), (11, base, "en", "a", 5),
    ]
    rows += [(20 + i, said(rng.randrange(1, 90)), rng.choice(["en", "de"]), rng.choice("abc"), i) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(document_rows(), NAMES).cache()


@pytest.fixture(scope="session")
def wide(documents):
    """The same with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], NAMES)


def records(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
