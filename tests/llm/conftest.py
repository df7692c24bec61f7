import pytest
from pyspark.sql import functions as F

AWKWARD = [
    (1, "The cat sat on the mat. It was glad."), (1, "The cat sat on the mat. It was glad."), (2, None), (3, ""),
    (4, " \n\t "), (None, "no id here, but text"), (None, None), (5, "word " * 3000), (6, "x" * 20000),
    (7, "the cat SAT on the mat. it was glad."), (8, "é ß ñ   done\x00."),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns whose names clash with inner ones."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(9).alias("score"),
                     F.lit("k").alias("n_words"), F.lit(1.5).alias("fp"), F.lit(0).alias("id"),
                     F.lit("z").alias("component_id"), F.lit(3).alias("c0"), F.lit(2).alias("a.b"))


@pytest.fixture(scope="session")
def no_docs(awkward):
    return awkward.where("false")
