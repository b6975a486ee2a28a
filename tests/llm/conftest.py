import random

import pytest
from pyspark.sql import types as T

WORDS = "the of and river stone amber quiet market lantern copper violet harbour meadow signal thunder".split()

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators might use for themselves
    T.StructField("_salt", T.LongType()), T.StructField("_rules", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_bytes", T.StringType()),
])


def prose(seed: int, size: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(400)) for _ in range(size))


def odd_rows() -> list[tuple]:
    """Nulls, empty and long texts, copies, repeated rows and ids."""
    base, long = prose(1, 120), prose(2, 30_000)
    texts = [
        (1, base), (2, base), (2, base), (3, None), (None, prose(3, 90)), (None, None), (4, ""), (5, " \t\n"), (6, long),
        (7, base + " tail"), (8, "naïve café — 中文 🙂 " + prose(4, 80)), (9, "a"), (9, prose(5, 70)), (10, prose(6, 60) + "\n" + prose(7, 40)),
    ]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"h{k % 2}", None if t is None else len(t), k, "x", "y", "z") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
