"""Sequence generation from prompts, around an injected generator.

Sampling can't be repeated, so generated rows are written before anything reads them twice (`materialised`)."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import re
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import templated
from tessitura.functions.tokens import BEGIN, TEXT_IDS
from tessitura.plans.session import GENERATED

#: What the published checkpoint was trained with, and a run's defaults.
SYSTEM_PREFIX = "You are a world-class composer. Please compose some music according to the following description: "
TEMPERATURE, TOP_P, MAX_TOKENS, N_OUTPUTS = 1.0, 0.98, 2046, 4


class Generator(Protocol):
    """Loaded once in each Python worker."""

    def encode(self, text: str) -> list[int]: ...

    def sample(self, ids: list[int], n: int, temperature: float, top_p: float, max_tokens: int) -> list[list[int]]:
        """n sequences of shifted ids, without the prompt's."""


class HashGenerator:
    """Stands in for a model: ids follow from a hash of the prompt's ids. It makes valid triples, not music."""

    def encode(self, text: str) -> list[int]:
        return [b + 1 for b in text.encode()]

    def sample(self, ids: list[int], n: int, temperature: float, top_p: float, max_tokens: int) -> list[list[int]]:
        out = []
        for k in range(n):
            seed = hashlib.sha256(f"{k}:{ids}".encode()).digest()
            notes = min(max_tokens // 3, 8 + seed[0] % 25)
            own, now = [], 0
            for j in range(notes):
                step = hashlib.sha256(seed + bytes([j])).digest()
                now += step[0] % 50
                own += [now, 10000 + 10 + step[1] % 190, 11000 + 128 * (step[2] % 8) + 36 + step[3] % 48]
            out.append([TEXT_IDS + x for x in own])
        return out


#: Generators by the name that `--model` gives. Further ones are added here, or named as module:attribute.
GENERATORS: dict[str, Callable[..., Generator]] = {"hash": HashGenerator}


def maker(model: str, **options) -> Callable[[], Generator]:
    """What makes the named generator in a worker. Options that are set but not taken by it raise ValueError."""
    if model in GENERATORS:
        kind = GENERATORS[model]
    elif re.fullmatch(r"[\w.]+:\w+", model):
        module, _, name = model.partition(":")
        kind = getattr(importlib.import_module(module), name)
    else:
        raise ValueError(f"no generator named {model!r}; known are {sorted(GENERATORS)}, and module:attribute")
    given = {k: v for k, v in options.items() if v not in (None, False)}
    takes = inspect.signature(kind).parameters
    if unknown := [k for k in given if k not in takes and not any(p.kind is p.VAR_KEYWORD for p in takes.values())]:
        raise ValueError(f"generator {model!r} has no option {', '.join(unknown)}")
    return partial(kind, **given)


def generated(prompts: DataFrame, make: Callable[[], Generator] = HashGenerator, n_outputs: int = N_OUTPUTS, prefix: str = SYSTEM_PREFIX, temperature: float = TEMPERATURE, top_p: float = TOP_P, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """prompt_idx, output_idx (from 1), requested, secs, tokens (unshifted) for prompts (prompt_idx, prompt)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for idx, full in zip(frame["prompt_idx"], frame["full"], strict=True):
                began = time.perf_counter()
                outputs = model.sample([*model.encode(full), TEXT_IDS + BEGIN], n_outputs, temperature, top_p, max_tokens)
                secs = time.perf_counter() - began
                rows += [(idx, k, n_outputs, secs, [x - TEXT_IDS for x in ids]) for k, ids in enumerate(outputs, 1)]
            yield pd.DataFrame(rows, columns=GENERATED.names)

    return prompts.select("prompt_idx", templated(F.col("prompt"), prefix).alias("full")).mapInPandas(work, GENERATED)


def materialised(generation: DataFrame, folder: str | None = None) -> DataFrame:
    """Written once and read again: in `folder`, or in the one that spark.checkpoint.dir names."""
    spark = generation.sparkSession
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("name a folder or set spark.checkpoint.dir")
    path = f"{root.rstrip('/')}/generated-{uuid.uuid4().hex}"
    generation.write.parquet(path)
    return spark.read.schema(generation.schema).parquet(path)
