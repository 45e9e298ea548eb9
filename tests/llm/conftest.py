import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_tables import no_documents, odd_documents  # noqa: E402


@pytest.fixture
def odd(spark):
    return odd_documents(spark)


@pytest.fixture
def none(spark):
    return no_documents(spark)
