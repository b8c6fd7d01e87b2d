import os
import sys

import pytest
from pyspark.sql import Row

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
#: Ids that repeat, nulls in both columns, empty and blank texts, a very long text, exact copies and ties.
ODD = [(1, "the quick brown fox jumps over the lazy dog and runs away from here today"), (1, "the quick brown fox jumps over the lazy dog and runs away from here today"),
       (2, None), (3, ""), (4, " \t\n "), (None, "a text without an id that has some words in it"), (None, None), (5, LONG), (6, LONG),
       (7, "word"), (8, "word " * 400), (9, "naïve Ünïcode 日本語 test <|endoftext|> don't   stop\n\n now"), (10, "x" * 30_000)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows in a table with columns that clash with the operators' own names."""
    rows = [Row(block=i, doc_id=a, text=b, id="id", n_words="7", kept=None, Text2="t", key=1.5, component_id="c") for i, (a, b) in enumerate(ODD)]
    return spark.createDataFrame(rows, "block int, doc_id long, text string, id string, n_words string, kept string, Text2 string, key double, component_id string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
