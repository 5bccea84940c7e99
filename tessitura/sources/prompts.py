"""Where prompts and ids come from."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.text import strip


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """prompt_idx (from 1), prompt: the stripped lines of one text file in order, without blank ones. Lines end with LF,
    CR LF or CR. Each split of the file counts its own lines, and those of the splits before it are added."""
    block = F.col("_metadata.file_block_start").alias("block")
    rows = spark.read.text(path).select(block, F.monotonically_increasing_id().alias("k"), strip(F.col("value")).alias("prompt")).where("prompt <> ''")
    sizes = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for b in sorted(sizes):
        before.append((b, at))
        at += sizes[b]
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy("block").orderBy("k")))
    numbered = numbered.join(spark.createDataFrame(before, "block long, before long"), "block")
    return numbered.select((F.col("before") + F.col("own")).alias("prompt_idx"), "prompt").orderBy("prompt_idx")


def given(spark: SparkSession, *prompts: str) -> DataFrame:
    """Prompts from arguments, in their order."""
    return spark.createDataFrame(list(enumerate(prompts, 1)), "prompt_idx long, prompt string")


def chosen(spark: SparkSession, prompt: str | None = None, prompts_file: str | None = None, interactive: bool = False) -> DataFrame | None:
    """Prompts from one of an argument and a file; None where only interactive ones are wanted. ValueError otherwise."""
    if prompt and prompts_file:
        raise ValueError("a prompt and a prompts file exclude each other")
    if prompt:
        return given(spark, prompt)
    if prompts_file:
        return lines_of(spark, prompts_file)
    if not interactive:
        raise ValueError("give a prompt, a prompts file, or interactive")
    return None


def ingested(rows: DataFrame, order: str, text: str) -> DataFrame:
    """`order`, prompt: stripped texts of a table, without blank ones. Order stays a column, so nothing is sorted."""
    return rows.select(order, strip(F.col(text)).alias("prompt")).where("prompt <> ''")


def ids_in(lines: DataFrame, text: str = "value") -> DataFrame:
    """id: the lines of 32 hexadecimal digits in small letters, without white space around them, each once."""
    return lines.select(strip(F.col(text)).alias("id")).where(F.col("id").rlike(r"\A[0-9a-f]{32}\z")).distinct()


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: those of a text file."""
    return ids_in(spark.read.text(path))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of .wav and .mp3 files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{wav,mp3}").load(path).select("path", "content")


def require_file(spark: SparkSession, path: str) -> str:
    """The path, if a file is there on the store it names; FileNotFoundError otherwise."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if re.match(r"\s*$", path) or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    return path
