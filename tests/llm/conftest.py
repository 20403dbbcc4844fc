import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with every awkward row: missing, empty, blank, long, repeated, clashing names."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if not extra:
            return df
        return df.selectExpr(
            "doc_id", "text", "1 AS ids", "2 AS score", "'x' AS key", "3L AS hash", "4 AS n_words"
        )

    return make


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (None, "missing id"), (4, "a"), (4, "a"), (5, "é🙂 ñ")]
