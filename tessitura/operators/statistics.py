"""Run statistics of generated outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_statistics(outcomes: DataFrame) -> DataFrame:
    """One row from outcomes (prompt_idx, output_idx, secs, ok): total_prompts, successful_generations,
    failed_generations, timed_prompts, average_time. Outputs of a prompt share its seconds; the first prompt warms the
    model up and isn't timed; without timed prompts the average is 0."""
    prompts = outcomes.groupBy("prompt_idx").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.min("secs").alias("secs"))
    timed = F.when(F.col("prompt_idx") > 1, F.col("secs"))
    return prompts.agg(
        F.count("*").alias("total_prompts"),
        F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("successful_generations"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("failed_generations"),
        F.count(timed).alias("timed_prompts"),
        F.round(F.coalesce(F.avg(timed), F.lit(0.0)), 6).alias("average_time"),
    )


def failures_as_requested(outcomes: DataFrame) -> DataFrame:
    """prompt_idx, failed_generations against the number requested, which may exceed the number returned."""
    return outcomes.groupBy("prompt_idx").agg((F.max("requested") - F.count_if("ok")).cast("long").alias("failed_generations"))


def run_times(outcomes: DataFrame, *group: str) -> DataFrame:
    """`group`, began, total_time: a run's first beginning and the seconds from it to the last end, for outcomes with began
    (timestamp) and secs; those without either don't count."""
    known = outcomes.where("began is not null and secs is not null")
    start = F.unix_micros(F.col("began").cast("timestamp")) / 1e6
    return known.groupBy(*group).agg(F.min("began").alias("began"), (F.max(start + F.col("secs")) - F.min(start)).alias("total_time"))


def output_files(outcomes: DataFrame, group: str) -> DataFrame:
    """`group`, files: paths of good outputs, in order of prompt and output, MIDI before audio."""
    rank = F.when(F.col("path").endswith(".mid"), 0).otherwise(1)
    listed = F.array_sort(F.collect_list(F.struct("prompt_idx", "output_idx", rank.alias("rank"), "path")))
    return outcomes.where("ok").groupBy(group).agg(listed.alias("l")).select(group, F.array_join(F.transform("l", lambda x: x["path"]), ",").alias("files"))
