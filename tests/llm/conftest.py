import pytest

from cohortlens.llm.common import importable


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)
