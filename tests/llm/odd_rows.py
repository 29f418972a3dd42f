"""Fixtures with every odd case."""

import pytest

from spanwise.llm.common import ship

#: Whatever may turn up: nulls, blanks, repeated rows, ties, marks of other scripts, long runs, a clashing extra column.
SHORT = [
    None, "", " ", "\n\n", "one", "One  two\tthree", "don't 'stop' it'll we've", "café naïve 漢字 १२ ½ 😀",
    "<|endoftext|> in <|endoftext|>", "x" * 5000, " " * 300, "a b c d e", "A B C D E", "12 34\r\n56", "՘ old letters ſ",
]
ROWS = "doc_id long, text string, lang string, source string, its_id string, leaf int, node int, rate double"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture()
def odd(spark):
    """Documents with every odd case, two rows twice, and a null id; the extra columns have names used inside."""
    rows = [(i, t, "en", "s", "x", 1, 2, 0.5) for i, t in enumerate(SHORT)]
    rows += [rows[5], rows[12], (None, "a b c d e", None, None, None, None, None, None), (3, "another text with one id", "de", "s", "y", 0, 0, 0.0)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], ROWS)


SF = "/root/testdata/sf0.001"
