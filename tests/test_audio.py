import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions.tokens import peak
from tessitura.operators.audio import OFFSET, block_powers, gated, gated_rows, levelled, loudness, samples_of, sounding, trimmed, wav, weighted
from tessitura.operators.notes import checked, density_of_rows
from tessitura.sources.wav import register

RATE = 48000


def tone(hertz, seconds, level=0.0, rate=RATE):
    return 10 ** (level / 20) * np.sin(2 * np.pi * hertz * np.arange(int(seconds * rate)) / rate)


def form(samples, rate, code, bits, extra=b""):
    """A WAV file of (time, channel) samples in any of the forms."""
    wide = samples[:, None] if samples.ndim == 1 else samples
    if code == 3:
        data = wide.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = np.clip(np.round(wide * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    elif bits == 24:
        data = b"".join(int(x).to_bytes(3, "little", signed=True) for x in np.clip(np.round(wide.ravel() * (1 << 23)), -(1 << 23), (1 << 23) - 1))
    else:
        data = np.clip(np.round(wide * (1 << bits - 1)), -(1 << bits - 1), (1 << bits - 1) - 1).astype(f"<i{bits // 8}").tobytes()
    k = wide.shape[1]
    fmt = struct.pack("<HHIIHH", code, k, rate, rate * k * bits // 8, k * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("rate", [48000, 44100, 22050])
def test_known_levels(rate):
    """A full sine of 997 Hz in one channel is -3.01; two channels add 3.01; silence has none."""
    one = tone(997, 5, rate=rate)
    assert loudness(one, rate) == pytest.approx(-3.01, abs=0.1)
    assert loudness(one / 10, rate) == pytest.approx(-23.01, abs=0.1)
    assert loudness(np.stack([one, one], 1), rate) == pytest.approx(0.0, abs=0.1)
    assert loudness(np.stack([one, 0 * one], 1), rate) == pytest.approx(-3.01, abs=0.1)
    assert loudness(np.stack([one * 0, one * 0, one * 0, one * 0, one], 1), rate) == pytest.approx(-3.01 + 10 * np.log10(1.41), abs=0.1)
    assert loudness(np.zeros(rate), rate) == -np.inf and loudness(one[: rate // 3], rate) == -np.inf and loudness(one[:0], rate) == -np.inf


def test_gates():
    """Parts under either gate don't count; with a part that does, loudness is the mean of powers."""
    loud = tone(997, 20, -23)
    assert loudness(np.concatenate([loud, tone(997, 20, -36)]), RATE) == pytest.approx(-26.01, abs=0.1)
    assert loudness(np.concatenate([loud, tone(997, 60, -80)]), RATE) == pytest.approx(-26.01, abs=0.1)
    assert loudness(np.concatenate([loud, tone(997, 20, -26)]), RATE) == pytest.approx(-3.01 + 10 * np.log10((10**-2.3 + 10**-2.6) / 2), abs=0.1)


def test_filters_by_recursion():
    """The response at 48 kHz equals the standard's own coefficients, applied sample by sample, also over pieces."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    want = x
    for b, a in (((1.53512485958697, -2.69169618940638, 1.19839281085285), (-1.69065929318241, 0.73248077421585)), ((1.0, -2.0, 1.0), (-1.99004745483398, 0.99007225036621))):
        out, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for v in want:
            y = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        want = np.array(out)
    assert np.abs(weighted(x, 48000) - want).max() < 1e-4
    long = np.concatenate([x, np.zeros(100)])
    import tessitura.operators.audio as audio

    before, audio.PIECE = audio.PIECE, 700
    try:
        assert np.abs(weighted(long, 48000)[:3000] - want).max() < 1e-4
    finally:
        audio.PIECE = before


def test_gating_as_rows(spark):
    rng = np.random.default_rng(2)
    own = {k: 10 ** rng.uniform(-9, 0, 300) for k in range(6)} | {10: np.array([1e-9]), 11: np.array([0.0, 0.5])}
    rows = spark.createDataFrame([(k, float(p)) for k, x in own.items() for p in x], "id int, power double")
    got = {r.id: r for r in gated_rows(rows).collect()}
    for k, x in own.items():
        assert got[k].n_blocks == len(x)
        assert got[k].loudness == pytest.approx(gated(x)) if np.isfinite(gated(x)) else got[k].loudness is None and got[k].n_gated == 0
    assert got[11].loudness == pytest.approx(OFFSET + 10 * np.log10(0.5))
    assert len(block_powers(np.zeros(RATE), RATE)) == 7


def test_levelled():
    x = tone(997, 3, -30)
    assert loudness(levelled(x, RATE), RATE) == pytest.approx(-18, abs=0.01)
    spiky = np.where(np.arange(RATE * 3) % 4800 == 0, 1.0, 0.001)
    assert np.abs(levelled(spiky, RATE)).max() == 1.0
    assert levelled(x[:100], RATE).tolist() == x[:100].tolist()


def test_silence_as_rows(spark):
    rng = np.random.default_rng(3)
    own = {}
    for k, (a, n, b) in enumerate([(5000, 9000, 3000), (0, 4096, 0), (700, 100, 6000), (0, 1, 0), (3000, 511, 2000), (0, 0, 4000)]):
        own[k] = np.concatenate([np.zeros(a), rng.normal(size=n), 1e-4 * rng.normal(size=b)]) if n else np.zeros(b)
    rows = [(k, i, float(v)) for k, x in own.items() for i, v in enumerate(x)] + [(77, 0, None)]
    got = {r.id: (r.n, r.start, r.end) for r in sounding(spark.createDataFrame(rows, "id int, i int, x double").repartition(5)).collect()}
    for k, x in own.items():
        n, start, end = got[k]
        assert n == len(x) and x[start:end].tolist() == trimmed(x).tolist()
    assert got[77] == (1, 0, 0) and 0 < got[0][1] < got[0][2] < 17000
    with pytest.raises(ValueError):
        sounding(spark.createDataFrame(rows, "id int, i int, x double"), frame=10, step=4)


@pytest.mark.parametrize("code,bits,error", [(1, 8, 1 / 127), (1, 16, 2**-15), (1, 24, 2**-23), (1, 32, 2**-31), (3, 32, 1e-7), (3, 64, 0)])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav_in_ranges(spark, tmp_path, code, bits, error, channels):
    register(spark)
    rng = np.random.default_rng(bits)
    x = rng.uniform(-0.9, 0.9, (5003, channels))
    x[3777, channels - 1] = -0.95
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.WAV").write_bytes(form(x, 8000, code, bits, b"LIST\x03\x00\x00\x00abc\x00"))
    (tmp_path / "none.wav").write_bytes(form(x[:0], 8000, code, bits))
    (tmp_path / "other.txt").write_text("x")
    rows = spark.read.format("tessitura_wav").option("block", 300).option("range", 1000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 6
    got = rows.collect()
    assert {(r.rate, r.channels) for r in got} == {(8000, channels)} and len(got) == channels * (5 * 4 + 1)
    for c in range(channels):
        own = np.concatenate([r.samples for r in sorted((r for r in got if r.channel == c), key=lambda r: r.start)])
        assert np.abs(own - x[:, c]).max() <= error
    assert rows.agg(F.max(peak(F.col("samples"))).alias("p")).first().p == pytest.approx(0.95, abs=max(error, 1e-9))
    assert np.abs(samples_of(form(x, 8000, code, bits))[0].reshape(x.shape) - x).max() <= error


def test_odd_wav_files(spark, tmp_path):
    register(spark)
    whole = wav(tone(440, 0.1), 8000)
    (tmp_path / "cut.wav").write_bytes(whole[:1001])
    assert sum(len(r.samples) for r in spark.read.format("tessitura_wav").load(f"file://{tmp_path}/cut.wav").collect()) == (1001 - 44) // 2
    for name, data in (("text.wav", b"hello"), ("none.wav", whole[:36]), ("law.wav", form(np.zeros((3, 1)), 8000, 7, 8))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="WAV|bits"):
            spark.read.format("tessitura_wav").load(str(tmp_path / name)).count()
    for path in ("s3a://x/y.wav", str(tmp_path / "missing.wav")):
        with pytest.raises(Exception):  # noqa: B017
            spark.read.format("tessitura_wav").load(path).count()


def test_density_of_rows(spark):
    """One sequence has nine tenths of the rows; nothing is gathered, and the plan sends sums only."""
    long = [("long", k, [7, 10005, 11000][k % 3] if k < 90 else [k, 10005, 11000][k % 3]) for k in range(30_000)]
    some = [("neg", 0, 5), ("neg", 3, -2), ("first", 1, -2), ("first", 0, 9)] + [("over", 3 * k, 5) for k in range(65)] + [("at", 3 * k, 5) for k in range(64)]
    rows = spark.createDataFrame(long + some, "seq_id string, pos long, token int").repartition(8)
    found = density_of_rows(rows)
    assert {r.seq_id: (r.n_tokens, r.status, r.ok) for r in found.collect()} == {"long": (30_000, "pass", True), "neg": (2, "error_negative", False), "first": (2, "pass", True), "over": (65, "excessive", False), "at": (64, "pass", True)}
    assert "collect_list" not in found._jdf.queryExecution().toString()
    arrays = spark.createDataFrame([(s, [t for r, p, t in long + some if r == s]) for s in ("long",)], "seq_id string, tokens array<int>")
    assert checked(arrays).first().status == "pass"
