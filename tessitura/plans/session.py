"""Session settings and the schema of generated rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

GENERATED = T.StructType(
    [
        T.StructField("prompt_idx", T.LongType()),
        T.StructField("output_idx", T.IntegerType()),
        T.StructField("requested", T.IntegerType()),
        T.StructField("secs", T.DoubleType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
    ]
)


def session(name: str = "tessitura", **conf: str) -> SparkSession:
    """A session with the settings results depend on: UTC, and adaptive execution for skew and partition sizes."""
    builder = SparkSession.builder.appName(name)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
