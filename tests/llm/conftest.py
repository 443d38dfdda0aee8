import itertools

import pytest

from llm_cases import AWKWARD, CLASHES, SCHEMA


@pytest.fixture
def table_of(spark, tmp_path):
    """Rows as a Parquet table of their own, with columns whose names clash if ``clash`` is set."""
    numbers = itertools.count()

    def make(rows, schema=SCHEMA, clash=False):
        df = spark.createDataFrame(rows, schema)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        path = str(tmp_path / f"table{next(numbers)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def awkward(table_of):
    return table_of(AWKWARD, clash=True)


@pytest.fixture
def nothing(table_of):
    return table_of([])
