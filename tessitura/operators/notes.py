"""Notes in token sequences: unpacking, counts per time, the density rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.tokens import MAX_NOTES, TRIPLE, density_status, times, triples


def unpacked(sequences: DataFrame) -> DataFrame:
    """seq_id, pos (from 1), time, dur, note: a row for each triple; sequences without tokens have none."""
    rows = sequences.select("seq_id", F.posexplode(triples(F.col("tokens"))).alias("pos", "t"))
    return rows.select("seq_id", (F.col("pos") + 1).cast("long").alias("pos"), "t.time", "t.dur", "t.note")


def notes_per_time(sequences: DataFrame) -> DataFrame:
    """seq_id, time, n of each time of a sequence. Counts are summed before the one shuffle."""
    return sequences.select("seq_id", F.explode(times(F.col("tokens"))).alias("time")).groupBy("seq_id", "time").agg(F.count("*").alias("n"))


def checked(sequences: DataFrame, limit: int = MAX_NOTES, validate: bool = True) -> DataFrame:
    """The sequences with status (see density_status) and ok; without `validate`, all are ok."""
    rows = sequences.withColumn("status", density_status(F.col("tokens"), limit))
    return rows.withColumn("ok", F.col("status") == "pass" if validate else F.lit(True))


def density_of_rows(tokens: DataFrame, limit: int = MAX_NOTES) -> DataFrame:
    """seq_id, n_tokens, status, ok of sequences whose tokens are rows (seq_id, pos from 0, token), for those too long for one
    row. Tokens are counted by sequence and time, and these counts by sequence; both are summed before they are shuffled,
    so a task sends a row for each time at most and no task holds a sequence. One without rows has no row here."""
    time = F.when(F.col("pos") % TRIPLE == 0, F.col("token"))
    counts = tokens.groupBy("seq_id", time.alias("time")).agg(F.count("*").alias("n"))
    most, least = F.max(F.when(F.col("time").isNotNull(), F.col("n"))), F.min("time")
    found = counts.groupBy("seq_id").agg(F.sum("n").alias("n_tokens"), most.alias("most"), least.alias("least"))
    status = F.when(F.col("least") < 0, "error_negative").when(F.col("most") > limit, "excessive").otherwise("pass")
    return found.select("seq_id", "n_tokens", status.alias("status"), (status == "pass").alias("ok"))


def event_tokens(events: DataFrame) -> DataFrame:
    """seq_id, pos, token: the tokens of `from_events` as rows, for what doesn't depend on their order: an event's place is
    its number."""
    parts = F.array(F.hour("ts"), (10000 + F.col("event_id") % 1000).cast("int"), (11000 + (F.col("event_id") * 7) % 16512).cast("int"))
    rows = events.select(F.col("user_id").alias("seq_id"), "event_id", F.posexplode(parts).alias("k", "token"))
    return rows.select("seq_id", (F.col("event_id") * TRIPLE + F.col("k")).alias("pos"), "token")


def from_events(events: DataFrame) -> DataFrame:
    """seq_id, tokens: events as a stand-in for music, a sequence for each user. Time is the hour, the rest follows from
    the event's number, in order of hour and number."""
    rows = events.select("user_id", F.hour("ts").alias("h"), "event_id")
    packed = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("h", "event_id"))).alias("e"))
    triple = F.transform("e", lambda e: F.array(e["h"], (10000 + e["event_id"] % 1000).cast("int"), (11000 + (e["event_id"] * 7) % 16512).cast("int")))
    return packed.select(F.col("user_id").alias("seq_id"), F.flatten(triple).alias("tokens"))
