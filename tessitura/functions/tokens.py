"""Column functions over token arrays.

Fixed values of the id space: text ids come first, music ids are shifted by their number, and the sequence mark follows the
music ids. A sequence is flat triples of time, duration and note.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_IDS = 128256
BEGIN = 55026
TRIPLE = 3
MAX_NOTES = 64


def with_begin(ids: Column) -> Column:
    """Ids of a prompt with the shifted sequence mark at the end."""
    return F.array_append(ids, F.lit(TEXT_IDS + BEGIN))


def without_prompt(output: Column, prompt_ids: Column) -> Column:
    """What a model has added after the ids it was given."""
    return F.slice(output, F.size(prompt_ids) + 1, F.greatest(F.size(output) - F.size(prompt_ids), F.lit(0)))


def shifted(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: x + TEXT_IDS)


def unshifted(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: x - TEXT_IDS)


def times(tokens: Column) -> Column:
    """Every third id from the first; also that of a triple that is cut off."""
    return F.filter(tokens, lambda x, i: i % TRIPLE == 0)


def all_allowed(tokens: Column) -> Column:
    """Whether all (unshifted) ids are music ids. The sequence mark is not."""
    return F.forall(tokens, lambda x: x.between(0, BEGIN - 1))


def triples(tokens: Column) -> Column:
    """Structs of time, dur and note; what a cut-off triple lacks is null."""
    at = F.sequence(F.lit(0), F.ceil(F.size(tokens) / TRIPLE).cast("int") - 1)
    made = F.transform(at, lambda k: F.struct(F.get(tokens, k * 3).alias("time"), F.get(tokens, k * 3 + 1).alias("dur"), F.get(tokens, k * 3 + 2).alias("note")))
    return F.when(F.size(tokens) > 0, made).otherwise(F.filter(made, lambda _: F.lit(False)))


def crowded(tokens: Column, limit: int = MAX_NOTES) -> Column:
    """Whether a time occurs more than `limit` times. Sorted, such a time equals the one `limit` places on, so each row
    decides alone: nothing is exploded or shuffled."""
    ordered = F.array_sort(times(tokens))
    pairs = F.greatest(F.size(ordered) - limit, F.lit(0))
    return F.exists(F.zip_with(F.slice(ordered, 1, pairs), F.slice(ordered, limit + 1, pairs), lambda a, b: a == b), lambda x: x)


def density_status(tokens: Column, limit: int = MAX_NOTES) -> Column:
    """pass, excessive, or why counting is impossible: error_empty, error_negative (a time below 0)."""
    return (
        F.when(tokens.isNull() | (F.size(tokens) == 0), "error_empty")
        .when(F.exists(times(tokens), lambda x: x < 0), "error_negative")
        .when(crowded(tokens, limit), "excessive")
        .otherwise("pass")
    )


def peak(wave: Column) -> Column:
    """Largest magnitude of a waveform; 0 where it is empty."""
    return F.coalesce(F.array_max(F.transform(wave, F.abs)), F.lit(0.0))


def limited(wave: Column) -> Column:
    """The waveform scaled to a peak of 1 where it exceeds that."""
    return F.when(peak(wave) > 1, F.transform(wave, lambda x: x / peak(wave))).otherwise(wave)
