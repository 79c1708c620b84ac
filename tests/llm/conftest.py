import numpy as np
import pytest

LONG = "the of and ted " * 9000


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) with extra columns whose names clash with those that operators add."""
    def build(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1.5, "y", 7) for i, t in rows],
            "doc_id long, text string, row_hash string, score double, fp string, n_tokens int")
    return build


@pytest.fixture(scope="session")
def prose():
    """Distinct sentences by number."""
    def build(seed, words=40):
        draw = np.random.default_rng(seed)
        return " ".join("".join(draw.choice(list("abcdefghij"), draw.integers(2, 7))) for _ in range(words))
    return build
