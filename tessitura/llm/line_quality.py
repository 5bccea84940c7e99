"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of bytes, repetition and shape, cut at training quantiles, of
the line itself and of both neighbours. The field's forward-backward marginals, weighted by line length, give the share
of a document that is good; one logistic curve turns it into a score.

It learns from documents whose labels are given: all lines of a good one are good; of a bad one those that a first,
lineless fit finds bad, and the worst in any case. The sample is at most `SAMPLE` labelled documents of `SAMPLE_BYTES` bytes
together, in the order of a hash of the id; a document that would go beyond these bytes is left out whole. Scoring covers every
text.

Defined results: null and empty texts are one empty line; without usable labels of both kinds every score is 0.5; rows
with null or conflicting labels count as bad if one label is 0 and are left out if all are null; of an id's rows the smallest
text is learned from; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.shared import apart, columns, discard, text_blocks, written
from tessitura.llm.words import NOT_SPACE, chained, hashed_words, mix, prefix_sums, span_hashes

#: Labelled documents to learn from, at most.
SAMPLE = 4000
#: Bytes of their texts, at most.
SAMPLE_BYTES = 1 << 27
#: Score from which a document counts as good.
GOOD = 0.7
BINS = 10

_KIND = np.full(256, 6, np.uint8)  # other marks
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 13, 11, 12]] = 3
_KIND[[44, 46, 58, 59, 39, 34, 45, 40, 41, 63]] = 4
_KIND[128:] = 5
_KIND[[33]] = 7
_KIND[[124]] = 8
KINDS = 9
FEATURES = KINDS + 6


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines, and the number of each text's first as offsets."""
    breaks = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(breaks, at)) + 1
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, at[1:]]), kind="stable")
    return starts, ends, np.concatenate([[0], np.cumsum(count)])


def _again(values: np.ndarray) -> np.ndarray:
    """True where a value stood earlier."""
    out = np.ones(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = False
    return out


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, weight of each line, line offsets of the texts)."""
    starts, ends, first = lines(data, at)
    size = ends - starts
    out = np.zeros((len(starts), FEATURES), np.float32)
    kind = _KIND[data]
    for k in range(KINDS):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        out[:, k] = (sums[ends] - sums[starts]) / np.maximum(size, 1)
    out[:, KINDS] = np.log1p(size)
    words, begin, _, of = hashed_words(data, at, NOT_SPACE)
    line = np.searchsorted(starts, begin, "right") - 1
    n = np.bincount(line, minlength=len(starts))[: len(starts)]
    out[:, KINDS + 1] = size / np.maximum(n, 1)
    text = np.repeat(np.arange(len(at) - 1), np.diff(of))
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    if len(words) > 2:
        again = _again(chained(words, 3) ^ salt[:-2])
        out[:, KINDS + 2] = np.bincount(line[:-2], weights=again, minlength=len(starts))[: len(starts)] / np.maximum(n, 1)
    again = _again(words ^ mix(line.astype(np.uint64) + np.uint64(7)))
    out[:, KINDS + 3] = np.bincount(line, weights=again, minlength=len(starts))[: len(starts)] / np.maximum(n, 1)
    own = np.repeat(np.arange(len(at) - 1), np.diff(first))
    whole = span_hashes(prefix_sums(data), starts, ends) ^ mix(own.astype(np.uint64) + np.uint64(1))
    out[:, KINDS + 4] = _again(whole) & (size > 0)
    ended = np.zeros(len(starts), bool)
    some = size > 0
    ended[some] = np.isin(data[ends[some] - 1], np.frombuffer(b".?;:", np.uint8))
    out[:, KINDS + 5] = ended
    return out, np.maximum(size, 1).astype(float), first


@dataclass
class Field:
    """Cut points of the features, unary weights by feature, bin and neighbour, transitions [from, to], and the curve."""

    cuts: list[np.ndarray]
    unary: np.ndarray
    step: np.ndarray
    curve: tuple[float, float]

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        features, weight, first = line_features(data, at)
        log_odds = unary_log_odds(binned(features, self.cuts), first, self.unary)
        good = marginals(log_odds, first, self.step)
        share = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        return curve(share, self.curve)


def curve(share: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    p = np.clip(share, 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-np.clip(ab[0] * np.log(p / (1 - p)) + ab[1], -30, 30)))


def binned(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, features[:, k], "right") for k, c in enumerate(cuts)], axis=1)


def neighbours(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of the line before and after in its text, -1 for none."""
    n = first[-1]
    before, after = np.arange(n) - 1, np.arange(n) + 1
    before[first[:-1]] = -1
    after[first[1:] - 1] = -1
    return before, after


def unary_log_odds(bins: np.ndarray, first: np.ndarray, unary: np.ndarray) -> np.ndarray:
    k = np.arange(bins.shape[1])
    own = unary[0][k, bins].sum(axis=1) + unary[3][0, 0]
    before, after = neighbours(first)
    for which, w in ((before, unary[1]), (after, unary[2])):
        value = w[k, bins].sum(axis=1)
        own += np.where(which >= 0, value[which], 0)
    return own


def marginals(log_odds: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probability that each line is good, by forward and backward odds."""
    (w00, w01), (w10, w11) = np.exp(step).tolist()
    odds = np.exp(np.clip(log_odds, -30, 30)).tolist()
    out = np.empty(len(odds))
    cuts = first.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        ahead, x = [], None
        for e in odds[a:b]:
            x = e if x is None else e * (x * w11 + w01) / (x * w10 + w00)
            x = min(max(x, 1e-200), 1e200)
            ahead.append(x)
        y = 1.0
        for k in range(b - a - 1, -1, -1):
            z = ahead[k] * y
            out[a + k] = z / (1 + z)
            e = odds[a + k] * y
            y = (w11 * e + w10) / (w01 * e + w00)
    return out


def _passes(u: np.ndarray, first: np.ndarray, order: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of all lines, a position of all texts at a time (`order`: longest text first)."""
    size = np.diff(first)[order]
    begin = first[:-1][order]
    (w00, w01), (w10, w11) = step
    ahead, back = u.copy(), np.zeros_like(u)
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    for t in range(1, size[0]):
        i = begin[: live[t]] + t
        x = ahead[i - 1]
        ahead[i] += np.logaddexp(x + w11, w01) - np.logaddexp(x + w10, w00)
    for t in range(size[0] - 2, -1, -1):
        i = begin[: live[t + 1]] + t
        x = u[i + 1] + back[i + 1]
        back[i] = np.logaddexp(x + w11, w10) - np.logaddexp(x + w01, w00)
    return ahead, back


def fitted(features: np.ndarray, weight: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = 120) -> Field:
    """A field for texts with the given labels."""
    cuts = [np.unique(np.quantile(features[:, k], np.arange(1, BINS) / BINS)) for k in range(features.shape[1])]
    cuts = [np.unique(np.concatenate([c, [np.nextafter(features[:, k].min(), np.inf, dtype=np.float32)]])) for k, c in enumerate(cuts)]
    bins = binned(features, cuts)
    nf, nb = features.shape[1], BINS + 2
    flat = bins + np.arange(nf) * nb
    before, after = neighbours(first)
    text = np.repeat(np.arange(len(good)), np.diff(first))
    # Each text counts alike, however many lines it has, and so does each kind of text.
    balance = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    share = np.sqrt(weight)
    share = share / np.add.reduceat(share, first[:-1])[text] * balance[text] * len(good)

    def gradient(error: np.ndarray) -> np.ndarray:
        out = np.zeros((4, nf, nb))
        for k, which in enumerate((None, before, after)):
            if which is None:
                e, f = error, flat
            else:
                e, f = error[which >= 0], flat[which[which >= 0]]
            out[k] = np.bincount(f.ravel(), weights=np.repeat(e, nf), minlength=nf * nb).reshape(nf, nb)
        out[3, 0, 0] = error.sum()
        return out / len(good)

    def climb(label: np.ndarray, chain: bool, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unary, step = np.zeros((4, nf, nb)), np.zeros((2, 2))
        m1, m2 = [np.zeros_like(unary), np.zeros_like(step)], [np.zeros_like(unary), np.zeros_like(step)]
        order = np.argsort(-np.diff(first), kind="stable")
        inner = np.flatnonzero(after >= 0)
        for r in range(1, n + 1):
            u = unary_log_odds(bins, first, unary)
            if chain:
                ahead, back = _passes(u, first, order, step)
                p = 1 / (1 + np.exp(-np.clip(ahead + back, -30, 30)))
                x, y = ahead[inner], u[inner + 1] + back[inner + 1]
                joint = np.stack([np.zeros_like(x) + step[0, 0], y + step[0, 1], x + step[1, 0], x + y + step[1, 1]])
                joint = np.exp(joint - joint.max(axis=0))
                joint /= joint.sum(axis=0)
                seen = np.zeros_like(joint)
                seen[(2 * label[inner] + label[inner + 1]).astype(int), np.arange(len(inner))] = 1
                gs = ((seen - joint) * share[inner]).sum(axis=1).reshape(2, 2) / len(good) - 0.01 * step
            else:
                p, gs = 1 / (1 + np.exp(-np.clip(u, -30, 30))), np.zeros((2, 2))
            g = [gradient((label - p) * share) - 0.0005 * unary, gs]
            for k, w in enumerate((unary, step)):
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                w += 0.1 * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.99**r)) + 1e-6)
        return unary, step, p

    label = good[text].astype(float)
    _, _, p = climb(label, False, rounds)
    worst = np.zeros(len(p), bool)
    worst[np.lexsort((p, text))[first[:-1]]] = True
    label = np.where(~good[text] & (p < 0.5) | ~good[text] & worst, 0.0, 1.0)
    unary, step, _ = climb(label, True, rounds)
    m = marginals(unary_log_odds(bins, first, unary), first, step)
    share = np.add.reduceat(m * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    p = np.clip(share, 1e-4, 1 - 1e-4)
    x, a, b = np.log(p / (1 - p)), 1.0, 0.0
    for _ in range(500):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        a, b = a + 0.05 * (((good - q) * x).mean() - 0.001 * a), b + 0.3 * (good - q).mean()
    return Field(cuts, unary, step, (float(a), float(b)))


def learned(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field | None:
    """A field from at most `sample` labelled documents outside the held-out quarter, of at most `sample_bytes` bytes together,
    or None without both labels."""
    marks = columns(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # The ids are picked before texts are looked up, so only the sample's texts move.
    picked = marks.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # One text for each id, however many rows it has, so the table has at most `sample` rows.
    own = written(columns(documents, "doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")), "sample")
    room, chosen = sample_bytes, []
    for r in own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= room:
            chosen.append(r["doc_id"])
            room -= r["n"]
    rows = own.where(F.col("doc_id").isin(chosen)).select("text", "quality").orderBy(F.xxhash64("text")).toArrow()
    discard(own)
    good = np.array(rows["quality"].to_pylist(), float) > 0
    if not good.any() or good.all():
        return None
    parts = [line_features(data, at) for _, _, data, at in text_blocks(rows["text"].combine_chunks())]
    features, weight = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    return fitted(features, weight, first, good)


def scored(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: tuple[str, ...] = ("doc_id",), good: float = GOOD) -> DataFrame:
    """The columns `keep` and score and predicted for each document."""
    field = documents.sparkSession.sparkContext.broadcast(learned(documents, labels, sample))
    names = list(dict.fromkeys([*keep, "text"]))
    source = columns(documents, *names)
    types = dict(source.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if field.value is not None:
                for lo, hi, data, at in text_blocks(batch.column(names.index("text"))):
                    score[lo:hi] = field.value.scores(data, at)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(k)) for k in keep), pa.array(score), pa.array((score >= good).astype(np.int32))], [*keep, "score", "predicted"])

    return source.mapInArrow(work, ", ".join(f"`{k}` {types[k]}" for k in keep) + ", score double, predicted int")


def without_bad(documents: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """The documents that score `good` or more."""
    source, back = apart(documents, "doc_id", "text")
    return back(scored(source, labels, keep=tuple(source.columns), good=good).where("predicted = 1"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
