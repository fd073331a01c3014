import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import Words, make  # noqa: E402


@pytest.fixture
def words():
    return Words()


@pytest.fixture
def docs_of(spark):
    return lambda rows, extra="": make(spark, rows, extra)
