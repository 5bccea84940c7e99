"""Token triples as Standard MIDI files, and MIDI files as rows.

Files are written as expressions over the array of tokens: notes, tracks and their events are arrays of structs, numbers of
variable length are two digits or four, and the digits become bytes at the end. No Python worker is needed.

Fixed values of the vocabulary: times count 10 ms; durations follow from 10000; notes from 11000, as 128 pitches of each of
129 instruments, the last being drums; the rest and all later ids make no sound."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.arrays import bound

TIMES, DURATIONS, NOTES, REST = 0, 10000, 11000, 27512
PITCHES, DRUMS = 128, 128
#: Two quarters a second of 50 ticks each: a tick is 10 ms.
TICKS, MICROSECONDS, VELOCITY = 50, 500_000, 90
#: Fixed values of the format: the drums' channel, and the end of a track.
DRUM_CHANNEL, TRACK_END = 9, "00FF2F00"
FREE = [c for c in range(16) if c != DRUM_CHANNEL]
#: Rows of read files that leave a worker at once, about.
ROWS = 1 << 14


def _digits(x: Column, bytes_: int = 1) -> Column:
    return F.lpad(F.hex(x), 2 * bytes_, "0")


def _delta(ticks: Column) -> Column:
    """A number of variable length, as digits; times and durations of the vocabulary are below 2**14."""
    return F.when(ticks < 128, _digits(ticks)).otherwise(F.concat(_digits(F.shiftright(ticks, 7) + 128), _digits(ticks.bitwiseAND(127))))


def _event(instrument: Column, tick: Column, kind: int, *parts: Column | str) -> Column:
    digits = F.concat(*[F.lit(p) if isinstance(p, str) else _digits(p) for p in parts])
    return F.struct(instrument.alias("i"), tick.cast("int").alias("tick"), F.lit(kind).alias("kind"), digits.alias("m"))


def _ordered(notes: Column) -> Column:
    """Events of notes with their channels, by instrument and tick: an instrument's program, then ends before beginnings."""
    i = lambda x: x["n"]["instrument"]
    played = F.flatten(F.transform(notes, lambda x: F.array(_event(i(x), x["n"]["time"], 2, x["c"] + 0x90, x["n"]["pitch"], f"{VELOCITY:02X}"), _event(i(x), x["n"]["end"], 1, x["c"] + 0x80, x["n"]["pitch"], "00"))))
    melodic = F.array_distinct(F.transform(F.filter(notes, lambda x: i(x) != DRUMS), lambda x: F.struct(i(x).alias("i"), x["c"].alias("c"))))
    programs = F.transform(melodic, lambda x: _event(x["i"], F.lit(0), 0, x["c"] + 0xC0, x["i"]))
    return F.sort_array(F.concat(programs, played))


def _chunk(body: Column) -> Column:
    return F.concat(F.lit(b"MTrk".hex().upper()), _digits(F.length(body) / 2, 4), body)


def _notes(tokens: Column) -> Column:
    """Structs of time, end, instrument and pitch. A cut-off triple and triples with ids outside their ranges are left out."""
    count = F.floor(F.size(tokens) / 3).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.struct(F.get(tokens, k * 3).alias("t"), F.get(tokens, k * 3 + 1).alias("d"), F.get(tokens, k * 3 + 2).alias("n"), (k < count).alias("whole")))
    good = F.filter(own, lambda x: x["whole"] & (x["t"] >= TIMES) & (x["t"] < DURATIONS) & (x["d"] >= DURATIONS) & (x["d"] < NOTES) & (x["n"] >= NOTES) & (x["n"] < REST))
    return F.transform(good, lambda x: F.struct(x["t"].alias("time"), (x["t"] + F.greatest(x["d"] - DURATIONS, F.lit(1))).alias("end"), F.floor((x["n"] - NOTES) / PITCHES).cast("int").alias("instrument"), ((x["n"] - NOTES) % PITCHES).alias("pitch")))


def _track(events: Column) -> Column:
    """A track from its events, which are in order."""
    coded = F.transform(events, lambda x, k: F.concat(_delta(x["tick"] - F.coalesce(F.get(events, k - 1)["tick"], F.lit(0))), x["m"]))
    return bound(F.concat(F.array_join(coded, ""), F.lit(TRACK_END)), _chunk)


def midi(tokens: Column) -> Column:
    """The bytes of a format 1 file: a tempo track, then a track for each instrument. Channels go round in order of the
    instruments' first notes where there are more than fifteen; drums have the tenth."""

    free = F.array(*[F.lit(c) for c in FREE])

    def file(notes: Column) -> Column:
        melodic = F.array_distinct(F.transform(F.filter(notes, lambda x: x["instrument"] != DRUMS), lambda x: x["instrument"]))
        # Each note's channel, by the place of its instrument among the melodic ones.
        placed = lambda names: F.transform(notes, lambda x: F.struct(x.alias("n"), F.when(x["instrument"] == DRUMS, F.lit(DRUM_CHANNEL)).otherwise(F.get(free, ((F.array_position(names, x["instrument"]) - 1) % len(FREE)).cast("int"))).alias("c")))
        return bound(bound(bound(melodic, placed), _ordered), tracks)

    def tracks(events: Column) -> Column:
        """Events of an instrument stand together; its track is a slice."""
        starts = F.filter(F.transform(events, lambda x, k: F.when((k == 0) | (x["i"] != F.get(events, k - 1)["i"]), k)), lambda k: k.isNotNull())
        ends = lambda at: F.transform(at, lambda k, j: F.struct(k.alias("a"), F.coalesce(F.get(at, j + 1), F.size(events)).alias("b")))
        made = F.transform(bound(starts, ends), lambda s: bound(F.slice(events, s["a"] + 1, s["b"] - s["a"]), _track))
        tempo = _chunk(F.lit(f"00FF5103{MICROSECONDS:06X}{TRACK_END}"))
        head = lambda t: F.concat(F.lit(b"MThd".hex().upper() + "000000060001"), _digits(F.size(t) + 1, 2), F.lit(f"{TICKS:04X}"), tempo, F.array_join(t, ""))
        return F.unhex(bound(made, head))

    return F.when(tokens.isNotNull(), bound(_notes(tokens), file))


def with_midi(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("midi", midi(F.col("tokens")))


def _events(data: bytes) -> np.ndarray:
    """Rows (track, place in the file, microseconds, channel, pitch, velocity, program) of a file's notes; velocity 0 ends one.
    Messages without a status byte have that of the one before. Changes of tempo hold for all tracks."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    division = int.from_bytes(data[12:14], "big")
    at, found, tempos = 8 + int.from_bytes(data[4:8], "big"), array("q"), [(0, 500_000)]
    track = 0
    while at + 8 <= len(data):
        kind, end = data[at : at + 4], at + 8 + int.from_bytes(data[at + 4 : at + 8], "big")
        at += 8
        tick = status = 0
        program = [0] * 16
        while kind == b"MTrk" and at < min(end, len(data)):
            delta = 0
            while True:
                b = data[at]
                at += 1
                delta = delta << 7 | b & 127
                if b < 128:
                    break
            tick += delta
            if data[at] >= 0x80:
                status = data[at]
                at += 1
            if status >= 0xF0:
                if status == 0xFF:
                    if data[at] == 0x51:
                        tempos.append((tick, int.from_bytes(data[at + 2 : at + 5], "big")))
                    at += 1
                size = 0
                while True:
                    b = data[at]
                    at += 1
                    size = size << 7 | b & 127
                    if b < 128:
                        break
                at += size
                continue
            channel, what = status & 15, status >> 4
            if what in (8, 9):
                found.extend((track, len(found) // 7, tick, channel, data[at], data[at + 1] if what == 9 else 0, program[channel]))
            elif what == 12:
                program[channel] = data[at]
            at += 1 if what in (12, 13) else 2
        at, track = end, track + 1
    rows = np.array(found, np.int64).reshape(-1, 7)
    if not len(rows):
        return rows
    ticks = rows[:, 2].astype(float)
    if division & 0x8000:  # frames a second, and ticks of each
        micros = ticks * 1e6 / ((256 - (division >> 8)) * (division & 255))
    else:
        tempos.sort(key=lambda x: x[0])
        edge = np.array([x[0] for x in tempos], float)
        each = np.array([x[1] for x in tempos], float) / division
        begun = np.concatenate([[0.0], np.cumsum(np.diff(edge) * each[:-1])])
        own = np.searchsorted(edge, ticks, "right") - 1
        micros = begun[own] + (ticks - edge[own]) * each[own]
    if not (micros < 1 << 62).all():  # a division of 0, or a time beyond all measure
        raise ValueError("times out of range")
    rows[:, 2] = np.rint(micros)
    return rows


EVENTS = "path string, track int, seq int, micros long, channel int, pitch int, velocity int, program int, error string"


def _told(held: list[tuple[str, np.ndarray, str | None]]) -> pa.RecordBatch:
    size = [len(rows) for _, rows, _ in held]
    of = pa.array(np.repeat(np.arange(len(held)), size))
    path, error = (pa.array(x, pa.string()).take(of) for x in ([h[0] for h in held], [h[2] for h in held]))
    bad, values = np.repeat([h[2] is not None for h in held], size), np.concatenate([h[1] for h in held])
    numbers = [pa.array(v.astype(np.int64 if k == 2 else np.int32), mask=bad) for k, v in enumerate(values.T)]
    return pa.RecordBatch.from_arrays([path, *numbers, error], [c.split()[0] for c in EVENTS.split(", ")])


def read_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of EVENTS from batches of path and content. Batches come out by their rows, so a batch of many files isn't held as rows."""
    held, n = [], 0
    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            try:
                rows, error = _events(bytes(content.as_py())), None
            except (ValueError, IndexError, TypeError, OverflowError) as e:
                rows, error = np.zeros((1, 7), np.int64), str(e) or type(e).__name__
            for lo in range(0, len(rows), ROWS):
                held.append((path.as_py(), rows[lo : lo + ROWS], error))
                n += len(held[-1][1])
                if n >= ROWS:
                    yield _told(held)
                    held, n = [], 0
    if held:
        yield _told(held)


def midi_events(files: DataFrame) -> DataFrame:
    """A row for each beginning or end of a note in MIDI files (path, content); of a file that can't be read, one row with the
    error and nulls."""
    return files.select("path", "content").mapInArrow(read_events, EVENTS)


def midi_notes(files: DataFrame) -> DataFrame:
    """path, time, dur, note: triples of the notes in MIDI files, in units of the vocabulary. Of equal pitches that sound at once
    in a track's channel, the first to begin is the first to end. Ends without a beginning, and notes that nothing ends,
    are left out; long durations are cut to the largest id."""
    key = ("path", "track", "channel", "pitch")
    run = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = midi_events(files).where("error is null").withColumn("step", F.when(F.col("velocity") > 0, 1).otherwise(-1))
    rows = rows.withColumn("open", F.sum("step").over(run)).withColumn("low", F.least(F.lit(0), F.min("open").over(run)))
    rows = rows.withColumn("stray", F.coalesce(F.col("low") < F.least(F.lit(0), F.lag("low").over(Window.partitionBy(*key).orderBy("seq"))), F.col("low") < 0))
    rows = rows.withColumn("number", F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).over(run)).withColumn("ended", F.sum(F.when(F.col("step") < 0, 1).otherwise(0)).over(run) + F.col("low"))
    rows = rows.where("step > 0 or not stray").withColumn("k", F.when(F.col("step") > 0, F.col("number")).otherwise(F.col("ended")))
    # What begins and what ends as the k-th of its key; the key's rows are together by now.
    begins, ends = (F.max(F.when(F.col("step") == s, F.col("micros"))) for s in (1, -1))
    both = rows.groupBy(*key, "k").agg(begins.alias("begin"), ends.alias("end"), F.max(F.when(F.col("step") > 0, F.col("program"))).alias("program"))
    both = both.where("begin is not null and end is not null")
    begin, end = F.round(F.col("begin") / 10_000).cast("int"), F.round(F.col("end") / 10_000).cast("int")
    instrument = F.when(F.col("channel") == DRUM_CHANNEL, DRUMS).otherwise(F.col("program"))
    dur = F.least(end - begin, F.lit(NOTES - DURATIONS - 1)) + DURATIONS
    return both.select("path", begin.alias("time"), dur.alias("dur"), (instrument * PITCHES + F.col("pitch") + NOTES).alias("note"))
