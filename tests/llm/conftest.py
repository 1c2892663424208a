"""Fixtures for the training-data operators."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import documents, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, edge_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def prose():
    """Texts of a small vocabulary: make(n, seed)."""

    def make(n, seed=0, low=5, high=120):
        rng = random.Random(seed)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
        weights = [1 / (i + 1) for i in range(len(words))]
        return [" ".join(rng.choices(words, weights, k=rng.randint(low, high))) for _ in range(n)]

    return make
