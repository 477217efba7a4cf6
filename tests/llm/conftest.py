import pytest


def frame(spark, rows, schema="doc_id bigint, text string, lang string"):
    return spark.createDataFrame(rows, schema)


#: Nulls, empty, blank and very long texts, repeated rows and ties.
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "word", "fr"), (4, "word", "fr"), (None, "no key here", None), (5, "very long " * 30_000, "de"),
    (6, "Ünï \U0001f600 ▁▁ \x00 text\nwith lines\n\nwith lines", "en"), (7, "Ünï \U0001f600 ▁▁ \x00 text\nwith lines\n\nwith lines", "en"),
]


@pytest.fixture
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture
def empty(spark):
    return frame(spark, [])
