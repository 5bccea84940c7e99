"""Training pairs: texts matched to music by id, and the evaluation split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(texts: DataFrame, music: DataFrame, on: str = "id") -> DataFrame:
    """Rows of both with an equal id."""
    return texts.join(music, on, "inner")


def split(rows: DataFrame, held_out: DataFrame, on: str = "id") -> DataFrame:
    """The rows with `part`: eval where the id is held out, else train. Repeated held-out ids don't repeat rows."""
    mark = "_held"
    while mark in rows.columns:
        mark += "_"
    ids = held_out.select(on).where(F.col(on).isNotNull()).distinct().withColumn(mark, F.lit(True))
    return rows.join(ids, on, "left").withColumn("part", F.when(F.col(mark), "eval").otherwise("train")).drop(mark)
