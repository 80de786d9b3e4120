import pytest
from pyspark.sql import functions as F

from eventloom.llm.common import ready

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def lab(spark):
    return ready(spark)


@pytest.fixture(scope="session")
def odd(lab):
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeated rows, and clashing columns."""
    long = " ".join(f"w{i * 7919 % 1000} of." for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (2, None, "en", "a"), (3, "", None, None),
        (None, "a text without an id, of some words", "en", "b"), (4, " \n\t ", "en", "b"), (5, long, "en", None), (6, long, None, "b"),
        (7, "the cat sat on the mat", "fr", "b"), (8, "漢字 \U0001f600 é", "zh", "c"), (9, "|| ### &&&\n|| ### &&&", "en", "c"),
    ]
    df = lab.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = "n_chars score key class nodes ids n_tokens held_out ranges size taken group script text_hash sentences".split()
    return df.select("*", *[F.lit("clash").alias(c) for c in extra]).repartition(3).persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
