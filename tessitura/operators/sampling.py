"""Ids sampled from logits: as rows of a table, and step by step around a model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.arrays import uniform
from tessitura.functions.sampling import Allowed, drawn
from tessitura.functions.tokens import BEGIN, TEXT_IDS


def sampled(steps: DataFrame, seed: str = "0", temperature: float = 1.0, top_p: float = 1.0, allowed: Allowed | None = None) -> DataFrame:
    """seq_id, step, token, p, n_kept for a table of (seq_id, step, logits). The draw follows from the seed, the sequence and
    the step, so a task that runs again draws the same. Nothing is shuffled."""
    found = steps.select("seq_id", "step", drawn(F.col("logits"), uniform(seed, F.col("seq_id"), F.col("step")), temperature, top_p, allowed).alias("d"))
    return found.select("seq_id", "step", "d.token", "d.p", "d.n_kept")


def music_ids(i):
    """Whether an id of a whole vocabulary is a (shifted) music id; the sequence mark and text ids are not."""
    return (i >= TEXT_IDS) & (i < TEXT_IDS + BEGIN)


def pick(logits: np.ndarray, u: float, temperature: float = 1.0, top_p: float = 1.0, allowed: np.ndarray | None = None) -> int | None:
    """The id that `drawn` draws, of one array of logits; `allowed` are the ids to choose from."""
    ids = np.flatnonzero(np.isfinite(logits)) if allowed is None else allowed[np.isfinite(logits[allowed])]
    if not len(ids):
        return None
    x = logits[ids].astype(float)
    if not temperature:
        return int(ids[np.argmax(x)])
    w = np.exp((x - x.max()) / temperature)
    order = np.lexsort((ids, -w))
    sums = np.cumsum(w[order])
    n = int(np.searchsorted(sums, sums[-1] * top_p, "left")) + 1
    return int(ids[order[np.searchsorted(sums[: min(n, len(sums))], u * sums[min(n, len(sums)) - 1], "right")]])


class SampledGenerator:
    """A generator (see `generation`) around a model that gives the logits of the next id: `logits(ids)` over the whole
    vocabulary, text ids first. Only music ids are drawn, unless other ids are given as allowed; `stop` ends a sequence."""

    def __init__(self, encode: Callable[[str], list[int]], logits: Callable[[Sequence[int]], np.ndarray], seed: str = "0", allowed: np.ndarray | None = None, stop: int | None = None):
        self.encode, self.logits, self.seed, self.stop = encode, logits, seed, stop
        self.allowed = np.arange(TEXT_IDS, TEXT_IDS + BEGIN) if allowed is None else allowed

    def sample(self, ids: list[int], n: int, temperature: float, top_p: float, max_tokens: int) -> list[list[int]]:
        out = []
        given = hashlib.md5(str(ids).encode()).hexdigest()
        for k in range(n):
            own: list[int] = []
            for step in range(max_tokens):
                digest = hashlib.md5(f"{self.seed}:{given}:{k}:{step}".encode()).hexdigest()
                token = pick(self.logits([*ids, *own]), int(digest[:13], 16) / 2**52, temperature, top_p, self.allowed)
                if token is None or token == self.stop:
                    break
                own.append(token)
            out.append(own)
        return out
