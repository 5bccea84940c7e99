"""WAV files as a source: `spark.read.format("tessitura_wav").load(path)`.

A file's frames are dealt out in ranges, each a partition, and read in blocks, each a row for each channel; so one long file is
many tasks, and a task holds one block. The path is a file, or a folder with .wav files below it, that all executors can open:
a path or a file: URI. Integer samples of 8, 16, 24 and 32 bits and floating ones of 32 and 64 are read, to [-1, 1) and as
they are. Files that are cut off have the frames that are there; files that aren't WAV raise ValueError."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Frames of a row and of a partition, unless options say otherwise.
BLOCK, RANGE = 1 << 16, 1 << 22
SCHEMA = "path string, rate int, channels int, channel int, start long, samples array<double>"
#: Fixed values of the format: codes of integer, floating and extended samples.
INTEGER, FLOATING, EXTENDED = 1, 3, 0xFFFE


@dataclass
class Form:
    """How a file's samples are kept: bytes of a frame, and where the frames begin."""

    code: int
    channels: int
    rate: int
    bits: int
    width: int
    start: int
    frames: int

    def samples(self, data: bytes) -> np.ndarray:
        """Of whole frames: a value each, or one for each channel."""
        if self.code == FLOATING:
            x = np.frombuffer(data, f"<f{self.bits // 8}").astype(float)
        elif self.bits == 8:
            x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
        elif self.bits == 24:
            raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / float(1 << 23)
        else:
            x = np.frombuffer(data, f"<i{self.bits // 8}") / float(1 << self.bits - 1)
        return x if self.channels == 1 else x.reshape(-1, self.channels)


def wav_form(file: BinaryIO) -> Form:
    """From the chunks before the samples."""
    size = file.seek(0, os.SEEK_END)
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    code = None
    while len(chunk := file.read(8)) == 8:
        kind, n = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        at = file.tell()
        if kind == b"fmt " and n >= 16:
            own = file.read(min(n, 40))
            code, channels, rate, _, width, bits = struct.unpack("<HHIIHH", own[:16])
            if code == EXTENDED and len(own) >= 26:
                code = struct.unpack("<H", own[24:26])[0]
            if (code, bits) not in {(INTEGER, 8), (INTEGER, 16), (INTEGER, 24), (INTEGER, 32), (FLOATING, 32), (FLOATING, 64)} or width != channels * bits // 8 or not channels:
                raise ValueError(f"samples of code {code} and {bits} bits can't be read")
        elif kind == b"data":
            if code is None:
                break
            return Form(code, channels, rate, bits, width, at, max(0, min(n, size - at)) // width)
        file.seek(at + n + n % 2)
    raise ValueError("a WAV file without samples")


def local_path(path: str) -> str:
    """The path that a path or file: URI names; ValueError for other stores."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return os.path.abspath(path)
    uri = urlparse(path)
    if uri.scheme != "file" or uri.netloc not in ("", "localhost"):
        raise ValueError(f"ranges of files can't be read from {uri.scheme}://; name a folder that all executors share")
    return os.path.abspath(unquote(uri.path))


@dataclass
class Range(InputPartition):
    path: str
    form: Form
    first: int
    last: int


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessitura_wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(local_path(self.options["path"]), int(self.options.get("block", BLOCK)), int(self.options.get("range", RANGE)))


class WavReader(DataSourceReader):
    def __init__(self, path: str, block: int, size: int):
        self.path, self.block, self.range = path, block, size

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".wav")) if os.path.isdir(self.path) else [self.path]
        out: list[InputPartition] = []
        for path in found:
            with open(path, "rb") as f:
                form = wav_form(f)
            out += [Range(path, form, a, min(a + self.range, form.frames)) for a in range(0, form.frames, self.range)]
        return out or [Range("", Form(INTEGER, 1, 1, 8, 1, 0, 0), 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        form, names = partition.form, ["path", "rate", "channels", "channel", "start", "samples"]
        if partition.first == partition.last:
            return
        with open(partition.path, "rb") as f:
            f.seek(form.start + partition.first * form.width)
            for at in range(partition.first, partition.last, self.block):
                n = min(self.block, partition.last - at)
                wide = form.samples(f.read(n * form.width)).reshape(n, -1)
                k = form.channels
                lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * n), pa.array(np.ascontiguousarray(wide.T).ravel()))
                columns = [pa.array([partition.path] * k), *(pa.array([x] * k, pa.int32()) for x in (form.rate, k)), pa.array(range(k), pa.int32()), pa.array([at] * k, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
