"""Small frames for the operators of the training-data pipeline."""

import random

import pytest

WORDS = "ba be bi bo bu da de di do du fa fe fi fo fu ga ge gi go gu ka ke ki ko ku la le li lo lu".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture
def docs(spark):
    """rows -> documents, with extra columns whose names the operators use inside."""

    def make(rows):
        data = [(i, t, g, s, len(t) if t is not None else None, -1, "x", 0.5) for i, t, g, s in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, row string, score double")

    return make
