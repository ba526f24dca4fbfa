"""Names and schemas shared by the lifecycles."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values.
CODE, TITLE, DESCRIPTION = "O*NET-SOC Code", "Title", "Description"
MISSING = ("", "nan", "none", "null", "n/a", "na")
MODEL_NAME = "sentence-transformers/all-MiniLM-L6-v2"
MODEL_REVISION = "1110a243fdf4706b3f48f1d95db1a4f5529b4d41"
BUDGET, TARGET, MODEL_LIMIT, WIDTH = 250, 245, 256, 384
CATEGORIES = ("Education", "Experience", "Skills", "Summary")


def strings(*names: str) -> T.StructType:
    """All columns as strings: codes must never become numbers."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SKILL = T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())])
TASK = T.StructType(
    [T.StructField("pos", T.LongType()), T.StructField("text", T.StringType()), T.StructField("core", T.BooleanType()), T.StructField("support", T.DoubleType())]
)
MATCHES = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("career_code", T.StringType()),
        T.StructField("career_title", T.StringType()),
        T.StructField("cosine_similarity", T.DoubleType()),
    ]
)
