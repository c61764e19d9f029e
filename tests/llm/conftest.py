import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    import helpers

    return helpers.documents(spark).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    import helpers

    return helpers.documents(spark, [])
