import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


# Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones.
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\n"),
    (4, LONG),
    (5, LONG),
    (None, "One two three"),
    (None, None),
    (6, "One two three"),
    (6, "One two three"),
    (7, "under the MIT License\nApache License, Version 2.0\nCC BY-NC 4.0"),
]
EXTRA = "doc_id long, text string, _id string, _tk string, _row string, kept string, n_lines string, ids string, score string, comp string, cls string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, *["x"] * 9) for i, t in ODD], EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EXTRA)
