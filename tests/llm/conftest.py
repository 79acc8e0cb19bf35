from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark: SparkSession):
    """A maker of document tables; ``extra`` adds columns whose names the operators use themselves."""

    def make(rows, extra: bool = False):
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            names = ("n", "n_tokens", "kept", "doc", "version", "gone", "_line_doc", "item", "start", "found", "label", "n_words")
            df = df.select("*", *(F.lit("x").alias(n) for n in names))
        return df

    return make
