import random
import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessitura.functions.text import strip, swapped_suffix, templated
from tessitura.functions.tokens import crowded, density_status, limited, peak, shifted, times, triples, unshifted, with_begin, without_prompt
from tessitura.operators.midi import DRUMS, DURATIONS, MICROSECONDS, NOTES, PITCHES, REST, ROWS, TICKS, TIMES, VELOCITY, midi_events, midi_notes, read_events, with_midi
from tessitura.operators.notes import checked, notes_per_time, unpacked

TRIPLE = [5, 10000, 11000]
CASES = [
    ("at limit", TRIPLE * 64, "pass"),
    ("over limit", TRIPLE * 65, "excessive"),
    ("negative time", [5, 10001, 11001, -2], "error_negative"),
    ("empty", [], "error_empty"),
    ("null", None, "error_empty"),
    ("negative duration", [5, -1, 11000], "pass"),
    ("part of a triple", [7], "pass"),
    ("cut off beyond limit", TRIPLE * 64 + [5], "excessive"),
    ("other order", [x for k in range(65) for x in (5, 10000, 11000 + k)][3:] + [9, 1, 1, 5, 2, 2], "excessive"),
]


def frame(spark, cases):
    return spark.createDataFrame([(n, t) for n, t, *_ in cases], "seq_id string, tokens array<int>")


def test_density_status(spark):
    got = {r.seq_id: (r.status, r.ok) for r in checked(frame(spark, CASES)).collect()}
    assert got == {n: (s, s == "pass") for n, _, s in CASES}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=30), min_size=1, max_size=8), st.integers(1, 5))
def test_crowded_against_counts(spark, sequences, limit):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(sequences)], "seq_id long, tokens array<int>")
    got = {r.seq_id: r.c for r in rows.select("seq_id", crowded(F.col("tokens"), limit).alias("c")).collect()}
    assert got == {k: any(t[::3].count(x) > limit for x in t[::3]) for k, t in enumerate(sequences)}
    counts = {(r.seq_id, r.time): r.n for r in notes_per_time(rows).collect()}
    assert counts == {(k, x): t[::3].count(x) for k, t in enumerate(sequences) for x in t[::3]}


def test_status_ignores_order_of_triples(spark):
    a, b = TRIPLE * 3 + [1, 2, 3], [1, 2, 3] + TRIPLE * 3
    rows = spark.createDataFrame([(a,), (b,)], "t array<int>").select(density_status(F.col("t"), 2).alias("s")).collect()
    assert {r.s for r in rows} == {"excessive"}


def test_token_functions(spark):
    row = spark.createDataFrame([([1, 2, 3, 4], [1, 2], [], [4, 5])], "t array<int>, p array<int>, e array<int>, q array<int>")
    got = row.select(
        with_begin(F.col("p")).alias("begin"),
        unshifted(shifted(F.col("t"))).alias("same"),
        without_prompt(F.col("t"), F.col("p")).alias("rest"),
        without_prompt(F.col("q"), F.col("t")).alias("shorter"),
        times(F.col("t")).alias("times"),
        triples(F.col("t")).alias("triples"),
        triples(F.col("e")).alias("none"),
    ).first()
    assert got.begin == [1, 2, 183282] and got.same == [1, 2, 3, 4] and got.rest == [3, 4] and got.shorter == [] and got.times == [1, 4]
    assert [tuple(x) for x in got.triples] == [(1, 2, 3), (4, None, None)] and got.none == []
    assert [(r.seq_id, r.pos, r.note) for r in unpacked(frame(spark, [("a", [1, 2, 3, 4]), ("b", [])])).collect()] == [("a", 1, 3), ("a", 2, None)]


def test_strip_is_pythons(spark):
    odd = ["", " ", "\t\x0b x\x1c\x1d\x1e\x1f\x85\xa0", " a b　 \n", "\r\nx", "​x​", "\x00x", "x "]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select(strip(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [x.strip() for x in odd]


def test_text_functions(spark):
    row = spark.createDataFrame([("p", "a.mid/b.mid", None)], "p string, path string, none string")
    got = row.select(templated(F.col("p"), "Say: ").alias("full"), swapped_suffix(F.col("path"), ".mp3").alias("audio"), templated(F.col("none"), "x").alias("n")).first()
    assert tuple(got) == ("Say: p ", "a.mid/b.mp3", None)


def test_waves(spark):
    row = spark.createDataFrame([([0.5, -2.0],), ([],), ([0.1],)], "w array<double>")
    assert [r.p for r in row.select(peak(F.col("w")).alias("p")).collect()] == [2.0, 0.0, 0.1]
    assert [r.l for r in row.select(limited(F.col("w")).alias("l")).collect()] == [[0.25, -1.0], [], [0.1]]


def _number(n: int) -> bytes:
    """A variable-length quantity."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def _track(events: list[tuple[int, int, bytes]]) -> bytes:
    body, now = b"", 0
    for at, _, message in sorted(events):
        body += _number(at - now) + message
        now = at
    body += _number(0) + b"\xff\x2f\x00"
    return b"MTrk" + struct.pack(">I", len(body)) + body


def encoded(tokens: list[int]) -> bytes:
    """The plain form of `midi`."""
    by: dict[int, list[tuple[int, int, bytes]]] = {}
    channel: dict[int, int] = {}
    free = [c for c in range(16) if c != 9]
    for time, dur, note in zip(tokens[::3], tokens[1::3], tokens[2::3], strict=False):
        if not (TIMES <= time < DURATIONS and DURATIONS <= dur < NOTES and NOTES <= note < REST):
            continue
        instrument, pitch = divmod(note - NOTES, PITCHES)
        if instrument not in by:
            channel[instrument] = 9 if instrument == DRUMS else free[len([i for i in channel if i != DRUMS]) % len(free)]
            by[instrument] = [] if instrument == DRUMS else [(0, 0, bytes([0xC0 | channel[instrument], instrument]))]
        c, end = channel[instrument], time + max(1, dur - DURATIONS)
        by[instrument] += [(time, 2, bytes([0x90 | c, pitch, VELOCITY])), (end, 1, bytes([0x80 | c, pitch, 0]))]
    tracks = [_track([(0, 0, b"\xff\x51\x03" + MICROSECONDS.to_bytes(3, "big"))]), *(_track(by[i]) for i in sorted(by))]
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), TICKS) + b"".join(tracks)


def parsed(data):
    """Note events (tick, channel, on, pitch) of a file."""
    assert data[:4] == b"MThd" and struct.unpack(">IHHH", data[4:14])[:2] == (6, 1)
    n, at, out = struct.unpack(">H", data[10:12])[0], 14, []
    for _ in range(n):
        assert data[at : at + 4] == b"MTrk"
        end = at + 8 + struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, now = at + 8, 0
        while at < end:
            delta = 0
            while True:
                b = data[at]
                at += 1
                delta = delta << 7 | b & 127
                if b < 128:
                    break
            now += delta
            status = data[at]
            if status == 255:
                at += 3 + data[at + 2]
            elif status >> 4 == 12:
                at += 2
            else:
                out.append((now, status & 15, status >> 4 == 9, data[at + 1]))
                at += 3
        assert at == end
    return sorted(out)


def test_midi_round_trip():
    tokens = [0, 10050, 11000 + 60, 200, 10010, 11000 + 128 * DRUMS + 36, 300, 10001, 27512, 5, 10001]
    assert parsed(encoded(tokens)) == sorted([(0, 0, True, 60), (50, 0, False, 60), (200, 9, True, 36), (210, 9, False, 36)])
    assert parsed(encoded([])) == []
    many = [x for k in range(40) for x in (100 * k, 10005, 11000 + 128 * k + 50)]
    assert len(parsed(encoded(many))) == 80 and all(c != 9 for _, c, _, _ in parsed(encoded(many)))


def pieces():
    random.seed(8)
    own = [TRIPLE, [], [1], [5, 10001], [0, 10050, 11060, 200, 10010, 11000 + 128 * DRUMS + 36, 300, 10001, 27512, 5, 10001], [x for k in range(40) for x in (9999 - 100 * k, 10999, 11000 + 128 * k + 50)]]
    for _ in range(60):
        own.append([x for _ in range(random.randint(1, 80)) for x in (random.randint(-3, 300), random.randint(9998, 10200), random.randint(10990, 11000 + 128 * random.choice((2, 129)) + 3))])
    return own


def test_with_midi(spark):
    own = pieces()
    rows = with_midi(frame(spark, [(str(k), t) for k, t in enumerate(own)] + [("none", None)]))
    got = {r.seq_id: r.midi for r in rows.collect()}
    assert got.pop("none") is None and {k: bytes(v) for k, v in got.items()} == {str(k): encoded(t) for k, t in enumerate(own)}
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_midi_files_read_back(spark):
    own = pieces()
    rows = with_midi(frame(spark, [(str(k), t) for k, t in enumerate(own)])).selectExpr("seq_id as path", "midi as content")
    got = {}
    for r in midi_notes(rows).collect():
        got.setdefault(r.path, []).append((r.time, r.dur, r.note))
    for k, t in enumerate(own):
        want, by = [], {}
        for time, dur, note in zip(t[::3], t[1::3], t[2::3], strict=False):
            if TIMES <= time < DURATIONS and DURATIONS <= dur < NOTES and NOTES <= note < REST:
                by.setdefault(note, []).append((time, time + max(1, dur - DURATIONS)))
        for note, spans in by.items():  # of one pitch, the first to begin is the first to end
            want += [(a, DURATIONS + b - a, note) for a, b in zip(sorted(a for a, _ in spans), sorted(b for _, b in spans), strict=True)]
        assert sorted(got.get(str(k), [])) == sorted(want)
    assert sum(map(len, got.values())) > 1000


def track(*events):
    body = b"".join(events) + b"\x00\xff\x2f\x00"
    return b"MTrk" + struct.pack(">I", len(body)) + body


def test_midi_files_of_others(spark):
    """Running status, ends as beginnings of velocity 0, tempo changes, system messages, strays, unknown chunks, broken files."""
    head = b"MThd" + struct.pack(">IHHH", 6, 1, 2, 100)
    tempo = track(b"\x00\xff\x51\x03\x07\xa1\x20", b"\x81\x48\xff\x51\x03\x0f\x42\x40")  # 5 ms a tick, from tick 200 on 10 ms
    notes = track(b"\x00\xf0\x02\x01\xf7", b"\x00\xc3\x05", b"\x64\x80\x3c\x00", b"\x00\x93\x3c\x40", b"\x64\x3c\x00", b"\x64\x3c\x50", b"\x00\x3d\x50", b"\x32\x3c\x00", b"\x00\xb3\x07\x50", b"\x00\x93\x3d\x00", b"\x0a\x3e\x40")
    files = [("a", head + tempo + b"XFIH\x00\x00\x00\x01\x00" + notes), ("b", b"RIFF"), ("c", head + notes[:30]), ("d", b""), ("e", None), ("f", head)]
    table = spark.createDataFrame([(p, c and bytearray(c)) for p, c in files], "path string, content binary")
    got = sorted(tuple(r)[1:] for r in midi_notes(table).where("path = 'a'").collect())
    piano = 11000 + 128 * 5
    assert got == [(50, 10050, piano + 60), (200, 10050, piano + 60), (200, 10050, piano + 61)] and midi_notes(table).where("path in ('b', 'd', 'e', 'f')").count() == 0
    assert {r.path for r in midi_events(table).where("error is not null").collect()} >= {"b", "d", "e"}


def test_midi_events_leave_in_small_batches():
    """2,000 files of 40 notes and a long one: what a worker gives back at once is bounded in rows, not in files."""
    files = {str(k): encoded([x for i in range(40) for x in (i, 10005, 11000 + (i + k) % 16512)]) for k in range(2000)}
    files["long"] = encoded([x for i in range(20_000) for x in (i % 9999, 10005, 11000 + i % 128)])
    batch = pa.RecordBatch.from_pydict({"path": [*files, "bad"], "content": [*files.values(), b"RIFF"]})
    made = list(read_events(iter([batch])))
    assert len(made) > 10 and max(b.num_rows for b in made) < 2 * ROWS
    got = {}
    for r in pa.Table.from_batches(made).to_pylist():
        got.setdefault(r["path"], []).append((r["seq"], r["error"]))
    assert got.pop("bad") == [(None, "not a MIDI file")]
    assert got == {p: [(k, None) for k in range(40_000 if p == "long" else 80)] for p in files}


def test_midi_times_out_of_range():
    """A division of 0, and a time of more than 64 bits: an error of the file, not of the job."""
    note, late = b"\x01\x90\x3c\x40", b"\xff" * 12 + b"\x7f\x90\x3c\x40"
    heads = [b"MThd" + struct.pack(">IHHH", 6, 1, 1, d) for d in (0, 100)]
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [heads[0] + track(note), heads[1] + track(late), heads[0] + track()]})
    assert [(r["path"], r["error"] is None) for b in read_events(iter([batch])) for r in b.to_pylist()] == [("a", False), ("b", False)]


@pytest.mark.parametrize("limit", [1, 64])
def test_empty_table(spark, limit):
    rows = frame(spark, []).where("seq_id is not null")
    assert checked(rows, limit).count() == notes_per_time(rows).count() == unpacked(rows).count() == 0
