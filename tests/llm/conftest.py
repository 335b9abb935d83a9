import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark):
    import helpers

    return spark.createDataFrame(helpers.rows(), helpers.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    import helpers

    return spark.createDataFrame([], helpers.SCHEMA)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    """A folder of tables, as queries take them."""
    path = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)
