import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

from tickloom.session import build_session  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, kept string, id string"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [
    (1, "The Cat sat on the mat", "en", "a", "x", "y"),
    (2, "the cat SAT on the mat", "en", None, "x", "y"),
    (2, "the cat SAT on the mat", "en", None, "x", "y"),  # repeated row
    (3, "", None, "a", None, None),
    (4, None, "fr", "a", None, None),
    (None, "no id here at all", "en", "b", None, None),
    (5, LONG, "en", "b", None, None),
    (6, LONG + " tail", "en", "b", None, None),
    (7, " \t\n ", "de", "b", None, None),
    (8, "ÉCOLE É", "fr", "b", None, None),
    (9, "école É", "fr", "b", None, None),
]


@pytest.fixture(scope="session")
def spark():
    return build_session("llm-tests", cores=4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
