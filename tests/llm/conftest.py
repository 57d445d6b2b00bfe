import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()), T.StructField("h", T.StringType()),
])
BLANK = " \t\n\x0b\f\r"


def words(text):
    return (text or "").encode().split()


def make_texts(seed=3):
    """Nulls, blanks, short and long texts, exact and near copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "ß", "ſ", "中文", "don't", "<|endoftext|>", "\x1c", "a\x00b", "Ü,", "..."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(150).split()
    out = [None, "", "   ", "\n\t", "one", "one two", "a b c d", "a b c d e", "A B C D E", text(5000)]
    out += [text(rng.randint(3, 120)) for _ in range(25)]
    out += [text(20) + " " + passage + "\n" + text(20) for _ in range(3)] + [passage, passage.replace(" ", "\n")]
    for edits in (1, 2, 3, 5, 9):
        for _ in range(4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [out[12], out[12], out[13] + " ", " " + out[13], " ".join(base), "r " * 90]
    return out


def rows_of(texts, repeat=True):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 4}", None, "k", "z", None) for i, t in enumerate(texts)]
    return rows + rows[20:23] if repeat else rows


@pytest.fixture(scope="session")
def odd_texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, odd_texts):
    return spark.createDataFrame(rows_of(odd_texts, repeat=False), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def docs_with_repeats(spark, odd_texts):
    null_id = [(None, "nobody knows my number at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows_of(odd_texts) + null_id, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
