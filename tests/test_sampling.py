import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions.sampling import drawn
from tessitura.operators.generation import generated
from tessitura.operators.sampling import SampledGenerator, music_ids, pick, sampled
from tessitura.sources.prompts import given

NAN, INF = float("nan"), float("inf")


def test_draws_equal_those_of_the_model_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(u), [float(x) for x in rng.normal(0, 2, 40)]) for k, u in enumerate(rng.random(60))]
    rows += [(100, 0.99, [1.0] * 10), (101, 0.0, [0.0, 5.0, 5.0])]
    table = spark.createDataFrame(rows, "k int, u double, logits array<double>")
    for temperature, top_p in ((1.0, 1.0), (0.5, 0.9), (2.0, 0.3), (1.0, 0.0), (0.0, 0.9)):
        got = {r.k: r.d.token for r in table.select("k", drawn(F.col("logits"), F.col("u"), temperature, top_p, lambda i: i % 3 != 1).alias("d")).collect()}
        for k, u, x in rows:
            allowed = np.array([i for i in range(len(x)) if i % 3 != 1])
            assert got[k] == pick(np.array(x), u, temperature, top_p, allowed)


def test_nucleus_is_the_smallest_set(spark):
    x = [math.log(p) for p in (0.1, 0.4, 0.2, 0.3)]
    table = spark.createDataFrame([(u / 100, x) for u in range(100)], "u double, logits array<double>")
    for top_p, ids in ((0.3, {1}), (0.41, {1, 3}), (0.69, {1, 3}), (0.71, {1, 2, 3}), (1.0, {0, 1, 2, 3})):
        got = table.select(drawn(F.col("logits"), F.col("u"), 1.0, top_p).alias("d")).select("d.*").collect()
        assert {r.token for r in got} == ids and all(r.n_kept == len(ids) for r in got)
    counts = Counter(r.token for r in got)
    assert [counts[k] for k in range(4)] == [pytest.approx(n, abs=1) for n in (10, 40, 20, 30)]
    assert {r.token: round(r.p, 9) for r in got} == {0: 0.1, 1: 0.4, 2: 0.2, 3: 0.3}


def test_odd_logits(spark):
    rows = [(1, 1, [None, NAN, INF, -INF, 0.0]), (1, 2, []), (2, 1, None), (3, 1, [None, NAN]), (4, 1, [1e9, -1e9])]
    got = {(r.seq_id, r.step): (r.token, r.n_kept) for r in sampled(spark.createDataFrame(rows, "seq_id int, step int, logits array<float>")).collect()}
    assert got == {(1, 1): (4, 1), (1, 2): (None, None), (2, 1): (None, None), (3, 1): (None, None), (4, 1): (0, 1)}


def test_runs_agree_and_seeds_differ(spark):
    rows = spark.range(200).select(F.col("id").alias("seq_id"), F.lit(1).alias("step"), F.array(*[F.lit(0.0)] * 50).alias("logits"))
    a, b, c = ([r.token for r in sampled(rows.repartition(n), seed).orderBy("seq_id").collect()] for n, seed in ((1, "a"), (3, "a"), (2, "b")))
    assert a == b != c and len(set(a)) > 30


def test_sequences_of_music_ids_only(spark):
    def make():
        def logits(ids):
            x = np.zeros(128256 + 55030, np.float32)
            x[:128256] = 50  # text is far likelier, but masked
            x[128256 + len(ids) % 7] = 3
            return x

        return SampledGenerator(lambda text: [len(text)], logits, "s")

    rows = generated(given(spark, "a", "bcd"), make, n_outputs=2, top_p=0.5, max_tokens=6).collect()
    assert len(rows) == 4 and all(len(r.tokens) == 6 and 0 <= min(r.tokens) and max(r.tokens) < 55026 for r in rows)
    assert len({tuple(r.tokens) for r in rows}) == 4
    again = generated(given(spark, "bcd", "a"), make, n_outputs=2, top_p=0.5, max_tokens=6).collect()
    assert {tuple(r.tokens) for r in rows} == {tuple(r.tokens) for r in again}
    stopping = SampledGenerator(lambda text: [], lambda ids: np.eye(5)[len(ids)] * 9, allowed=np.arange(5), stop=3).sample([], 1, 0.0, 1.0, 9)
    assert stopping == [[0, 1, 2]]


def test_music_ids(spark):
    got = spark.createDataFrame([(128255,), (128256,), (183281,), (183282,)], "i long").select(music_ids(F.col("i")).alias("ok")).collect()
    assert [r.ok for r in got] == [False, True, True, False]
