import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns with the operators' own names."""
    rows = [(1, "alpha beta gamma delta epsilon zeta", "x"), (2, None, "y"), (3, "", None), (None, "under the MIT license", "z"), (1, "alpha beta gamma delta epsilon zeta", "x"), (4, "word " * 30_000, "l"), (5, "é" * 3000, "u"), (6, "mail a.b@c.de or +1 (736) 555-2678, 10.0.0.1, 4111 1111 1111 1111", "p")]
    return spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, digest string, node long, length long")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, digest string, node long, length long")
