import random

import pytest

ODD_DOCS = "doc_id long, text string, score double, kept string, component_id string, digest string, key string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]


@pytest.fixture
def docs(spark):
    """Makes documents with extra columns whose names operators use themselves, over several partitions."""

    def make(rows):
        full = [(i, t, 1.0, "a", "b", "c", "d") for i, t in rows]
        return spark.createDataFrame(full, ODD_DOCS).repartition(3)

    return make
