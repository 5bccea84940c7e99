"""Audio from MIDI bytes, by a renderer that the caller supplies (none is part of Spark), and measures of audio as rows.

A renderer gets MIDI bytes and returns a waveform; what follows (silence at both ends cut off, loudness, peak limit, WAV) is
done here. One that encodes itself returns bytes instead.

Loudness is that of ITU-R BS.1770: samples pass a shelf and a high-pass filter; mean squares are taken over blocks of 400 ms, one
every 100 ms; blocks under -70, and then those 10 under the mean of the rest, don't count."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.sources.wav import wav_form

#: Silence is this many decibels below the loudest frame, in frames and steps of so many samples.
SILENCE_DB, FRAME, STEP = 30.0, 2048, 512
#: Fixed value: the loudness that audio is brought to.
LOUDNESS = -18.0
#: Fixed values of the loudness standard: its offset, gates, block and step in seconds, weights of channels (surround ones
#: count more), each filter's centre, gain and quality, and the power of the shelf's gain that its middle has.
OFFSET, GATE, RELATIVE_GATE, BLOCK, BLOCK_STEP = -0.691, -70.0, -10.0, 0.4, 0.1
CHANNELS = (1.0, 1.0, 1.0, 1.41, 1.41)
SHELF = (1681.974450955533, 3.999843853973347, 0.7071752369554196)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
BAND = 0.4996667741545416
#: Seconds after which nothing of the filters' response is left, and samples that are filtered at once.
TAIL, PIECE = 1.0, 1 << 20


class Renderer(Protocol):
    """Loaded once in each Python worker. `kind` is the files' ending."""

    kind: str

    def render(self, midi: bytes) -> tuple[np.ndarray, int] | bytes:
        """Samples in [-1, 1] or beyond (time, or time by channel) and their rate; or a whole encoded file."""


def trimmed(samples: np.ndarray, silence: float = SILENCE_DB) -> np.ndarray:
    """From the first to the last frame that is less than `silence` decibels below the loudest."""
    if not len(samples):
        return samples
    mono = samples if samples.ndim == 1 else samples.mean(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(np.pad(mono.astype(float), FRAME // 2) ** 2)])
    at = np.arange(0, len(mono) + 1, STEP)
    power = (sums[np.minimum(at + FRAME, len(sums) - 1)] - sums[at]) / FRAME
    loud = np.flatnonzero(power > power.max() * 10 ** (-silence / 10)) if power.max() > 0 else at[:0]
    return samples[loud[0] * STEP : min(len(mono), (loud[-1] + 1) * STEP)] if len(loud) else samples[:0]


def _response(rate: int, n: int) -> np.ndarray:
    """Both filters' frequency response for a transform of n samples."""
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)

    def ratio(b: tuple, a: tuple) -> np.ndarray:
        return (b[0] + b[1] * z + b[2] * z**2) / (a[0] + a[1] * z + a[2] * z**2)

    centre, gain, quality = SHELF
    k, high = np.tan(np.pi * centre / rate), 10 ** (gain / 20)
    band = high**BAND
    shelf = ratio((high + band * k / quality + k * k, 2 * (k * k - high), high - band * k / quality + k * k), (1 + k / quality + k * k, 2 * (k * k - 1), 1 - k / quality + k * k))
    centre, quality = HIGH_PASS
    k = np.tan(np.pi * centre / rate)
    return shelf * ratio((1, -2, 1), (1, 2 * (k * k - 1) / (1 + k / quality + k * k), (1 - k / quality + k * k) / (1 + k / quality + k * k)))


def weighted(samples: np.ndarray, rate: int) -> np.ndarray:
    """Samples (time, or time by channel) after both filters, piece by piece: what a piece leaves behind it is added to the next."""
    wide = (samples[:, None] if samples.ndim == 1 else samples).astype(float)
    tail = int(TAIL * rate)
    out = np.zeros((len(wide) + tail, wide.shape[1]))
    for at in range(0, len(wide), PIECE):
        own = wide[at : at + PIECE]
        n = 1 << (len(own) + tail - 1).bit_length()
        whole = np.fft.irfft(np.fft.rfft(own, n, axis=0) * _response(rate, n)[:, None], n, axis=0)
        out[at : at + len(own) + tail] += whole[: len(own) + tail]
    return out[: len(wide)].reshape(samples.shape)


def block_powers(samples: np.ndarray, rate: int) -> np.ndarray:
    """The mean squares of whole blocks, summed over channels by their weights."""
    own = weighted(samples[:, None] if samples.ndim == 1 else samples, rate)
    if own.shape[1] > len(CHANNELS):
        raise ValueError(f"loudness is defined for {len(CHANNELS)} channels at most")
    sums = np.concatenate([[0.0], np.cumsum(own**2 @ np.array(CHANNELS[: own.shape[1]]))])
    size = int(round(BLOCK * rate))
    at = np.round(np.arange(max(0, int((len(samples) - size) / (BLOCK_STEP * rate)) + 1 if len(samples) >= size else 0)) * BLOCK_STEP * rate).astype(int)
    return (sums[at + size] - sums[at]) / size


def gated(powers: np.ndarray) -> float:
    """Loudness of blocks; minus infinity where all are under the gate."""
    own = powers[powers > 10 ** ((GATE - OFFSET) / 10)]
    own = own[own > own.mean() * 10 ** (RELATIVE_GATE / 10)] if len(own) else own
    return OFFSET + 10 * float(np.log10(own.mean())) if len(own) else -np.inf


def loudness(samples: np.ndarray, rate: int) -> float:
    """Integrated loudness; minus infinity for silence and for less than a block."""
    return gated(block_powers(samples, rate))


def gated_rows(blocks: DataFrame) -> DataFrame:
    """id, n_blocks, n_gated (those that count), loudness (null where none does) for rows (id, power) of blocks. Both gates
    are sums by id, so the blocks of one long recording are never together."""
    loud = blocks.where(F.col("power") > 10 ** ((GATE - OFFSET) / 10))
    mean = loud.groupBy("id").agg(F.avg("power").alias("mean"))
    kept = loud.join(mean, "id").where(F.col("power") > F.col("mean") * 10 ** (RELATIVE_GATE / 10)).groupBy("id").agg(F.avg("power").alias("level"), F.count("*").alias("n_gated"))
    rows = blocks.groupBy("id").agg(F.count("*").alias("n_blocks")).join(kept, "id", "left")
    return rows.select("id", "n_blocks", F.coalesce("n_gated", F.lit(0)).alias("n_gated"), (F.log10("level") * 10 + OFFSET).alias("loudness"))


def sounding(samples: DataFrame, silence: float = SILENCE_DB, frame: int = FRAME, step: int = STEP) -> DataFrame:
    """id, n, start, end: what `trimmed` keeps of waveforms whose samples are rows (id, i from 0, x); start and end are 0 where
    all is silent. Squares are summed by steps before they are shuffled; a frame is the sum of the steps it covers, and
    `frame` must be a multiple of twice `step`. Samples that are missing or null are silent."""
    if frame % (2 * step):
        raise ValueError("frame must be a multiple of twice the step")
    half = frame // (2 * step)
    steps = samples.groupBy("id", F.floor(F.col("i") / step).alias("b")).agg(F.sum(F.col("x").cast("double") * F.col("x")).alias("e"), F.max("i").alias("last"))
    whole = steps.groupBy("id").agg((F.max("last") + 1).alias("n"))
    near = F.explode(F.sequence(F.greatest(F.col("b") - half + 1, F.lit(0)), F.col("b") + half)).alias("f")
    frames = steps.select("id", near, "e").groupBy("id", "f").agg(F.sum("e").alias("e"))
    frames = frames.join(whole, "id").where(F.col("f") <= F.floor(F.col("n") / step))
    most = frames.groupBy("id").agg(F.max("e").alias("most"))
    loud = frames.join(most, "id").where(F.col("e") > F.col("most") * 10 ** (-silence / 10))
    ends = loud.groupBy("id").agg((F.min("f") * step).alias("a"), ((F.max("f") + 1) * step).alias("b"))
    found = whole.join(ends, "id", "left")
    return found.select("id", "n", F.least(F.coalesce("a", F.lit(0)), "n").alias("start"), F.least(F.coalesce("b", F.lit(0)), "n").alias("end"))


def levelled(samples: np.ndarray, rate: int, meter: Callable[[np.ndarray, int], float] | None = loudness, target: float = LOUDNESS) -> np.ndarray:
    """Brought to the target by a meter of loudness (left as it is if that finds none), and then divided by its peak if over 1."""
    if meter and len(samples) and np.isfinite(now := meter(samples, rate)):
        samples = samples * 10 ** ((target - now) / 20)
    peak = float(np.abs(samples).max(initial=0))
    return samples / peak if peak > 1 else samples


def wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1 if samples.ndim == 1 else samples.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.round(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def samples_of(content: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAV file."""
    form = wav_form(io.BytesIO(content))
    return form.samples(content[form.start : form.start + form.frames * form.width]), form.rate


def with_audio(outputs: DataFrame, make: Callable[[], Renderer]) -> DataFrame:
    """`outputs` (with midi, ok) and audio, audio_kind, audio_status: "rendered", "skipped" where ok is false, or the error.
    A failure leaves the output itself as it is."""
    names = outputs.columns

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        meter = getattr(own, "loudness", loudness)
        for frame in frames:
            rows = []
            for midi, ok in zip(frame["midi"], frame["ok"], strict=True):
                if not ok:
                    rows.append((None, None, "skipped"))
                    continue
                try:
                    made = own.render(bytes(midi))
                    if not isinstance(made, bytes):
                        made = wav(levelled(trimmed(made[0]), made[1], meter), made[1])
                    rows.append((made, own.kind, "rendered"))
                except Exception as e:  # a renderer's own failures become the row's status
                    rows.append((None, None, f"error: {e}"))
            yield frame.assign(audio=[r[0] for r in rows], audio_kind=[r[1] for r in rows], audio_status=[r[2] for r in rows])

    schema = ", ".join(f"`{n}` {t}" for n, t in outputs.dtypes) + ", audio binary, audio_kind string, audio_status string"
    return outputs.select(*names).mapInPandas(work, schema)
