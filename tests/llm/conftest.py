import pytest

from snaplytics.llm.common import remove_stored


@pytest.fixture(autouse=True, scope="module")
def no_stored_tables_left(spark):
    yield
    remove_stored(spark)
