import os

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"


def table(name, sf=DIR):
    path = f"{sf}/{name}.parquet"
    return f"'{path}/*.parquet'" if os.path.isdir(path) else f"'{path}'"


@pytest.fixture(scope="session")
def small_texts():
    """(doc_id, text) of the smallest table, by doc_id."""
    return duckdb.sql(f"SELECT doc_id, text FROM {table('documents')} ORDER BY doc_id").fetchall()


#: What every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing column names.
ODD_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "x", 5),
    (1, "the quick brown fox jumps over the lazy dog again and again", "x", 5),
    (2, None, "x", None),
    (3, "", None, 0),
    (4, " \n\t ", "y", 4),
    (None, "a row without an id has a text all the same and it is kept", "y", 1),
    (5, "word " * 30_000, "z", 7),
    (6, "x" * 200_000, "z", 7),
    (7, "Ünïcode ß   \U0001f600 text", None, 2),
    (8, "the quick brown fox jumps over the lazy dog again and again", "x", 5),
]
ODD_SCHEMA = "doc_id long, text string, bucket string, kind long"


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
