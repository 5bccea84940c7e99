import math

import numpy as np
import pytest

from tessitura.llm.embedding_dedup import AUDIT, ENOUGH, FURTHER, near_duplicates, tables_for

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.98):
    ok = [v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    x = [np.array(np.array(v, np.float32), float) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    link = [[ok[i] and ok[j] and i != j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= threshold for j in range(len(rows))] for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if link[i][j] and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if v == a else v for v in label]
    least = {}
    for v, (d, _, _) in zip(label, rows, strict=True):
        if d is not None:
            least[v] = min(least.get(v, d), d)
    return sorted(str((d, int(sum(link[i])), least.get(label[i]), d == least.get(label[i]))) for i, (d, _, _) in enumerate(rows))


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0

    def add(v, label):
        nonlocal k
        rows.append((k, None if v is None else [None if x is None else float(x) for x in v], label))
        k += 1

    for label in (0, 1):
        for _ in range(250):
            add(rng.normal(size=16), label)
        for spread, n in ((0.02, 40), (0.05, 12), (0.3, 20)):
            centre = rng.normal(size=16)
            for _ in range(n):
                add(centre + spread * rng.normal(size=16), label)
        v = rng.normal(size=16)
        for scale in (1, 1, 2, 1e-20, 1e18):
            add(v * scale, label)
        turn, at = np.linalg.qr(rng.normal(size=(16, 2)))[0].T, np.arange(30) * 0.18
        for a in at:
            add(math.cos(a) * turn[0] + math.sin(a) * turn[1], label)
    for odd in (None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8):
        add(odd, 0)
    add(rows[0][1], None)
    add(rows[0][1], 0)
    rows.append(rows[3])
    rows.append((None, rows[5][1], 0))
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = near_duplicates(docs).collect()
    assert sorted(str((x.vec_id, x.n_links, x.component_id, x.kept)) for x in got) == brute(rows)


def test_linked_families_join(spark):
    """Two families of more members than a list holds, nearer to their own than to each other, all cross pairs linked."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    angle = math.acos(0.9865)
    rows = []
    for side, centre in enumerate((turn[0], math.cos(angle) * turn[0] + math.sin(angle) * turn[1])):
        for k in range(130):
            rows.append((side * 130 + k, [float(x) for x in centre + 0.003 * rng.normal(size=32)], 1))
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4), audit=0).collect()
    assert sorted(str((x.vec_id, x.n_links, x.component_id, x.kept)) for x in got) == brute(rows)
    assert {x.component_id for x in got} == {0} and {x.n_links for x in got} == {259}


def spread(rng, n, dim, pairs, angle):
    """Unit vectors, of which the first come in pairs at the angle."""
    x = rng.normal(size=(n, dim))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    for k in range(0, 2 * pairs, 2):
        turn = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        x[k + 1] = math.cos(angle) * x[k] + math.sin(angle) * turn / np.sqrt(turn @ turn)
    return x


def table(spark, x):
    return spark.createDataFrame([(k, [float(y) for y in v], 1, "x") for k, v in enumerate(x)], SCHEMA).repartition(4)


def test_rare_pairs(spark):
    """Thirty linked pairs, all alone, among 6,000 vectors, found without comparing all."""
    told = []
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table(spark, spread(np.random.default_rng(7), 6000, 32, 30, 0.195)), report=told.append).collect()}
    assert got == {k: (1, k // 2 * 2) if k < 60 else (0, k) for k in range(6000)}
    assert sum(t["nodes"] for t in told) <= 6000 * FURTHER // AUDIT


def test_vectors_without_links_are_not_all_compared(spark):
    told = []
    got = near_duplicates(table(spark, spread(np.random.default_rng(8), 10_000, 32, 0, 0)), report=told.append)
    assert got.where("n_links > 0 or not kept").count() == 0
    assert len(told) == 1 and told[0] == {"attempt": 0, "nodes": 10_000 * FURTHER // AUDIT, "links": 0, "lost": 0, "recall": None}


def test_low_recall_is_seen_and_mended(spark):
    """One table without descent misses pairs; audits see that, further attempts find more, and what audits see is used."""
    told = []
    x = spread(np.random.default_rng(9), 4000, 32, 1900, 0.195)
    rows = near_duplicates(table(spark, x), tables=1, rounds=0, audit=10, report=told.append).collect()
    assert told[0]["recall"] < 0.9 < told[-1]["recall"] and len(told) > 1 and told[0]["links"] >= ENOUGH
    assert sum(r.n_links for r in rows) > 0.9 * 3800


def test_low_recall_is_refused(spark, monkeypatch):
    from tessitura.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "_bucket_lists", lambda coded, k, floor: coded.sparkSession.createDataFrame([], embedding_dedup.EDGE))
    with pytest.raises(RuntimeError, match="edge recall of 0"):
        near_duplicates(table(spark, spread(np.random.default_rng(10), 1000, 16, 400, 0.1)), rounds=0)


def test_number_of_tables():
    for width in (0, 1, 7, 16, 24):
        n = tables_for(width, 0.98)
        miss = lambda m: (1 - (1 - math.acos(0.98) / math.pi) ** width) ** m
        assert miss(n) <= 1e-4 and (n == 1 or miss(n - 1) > 1e-4)


def test_uneven_signs(spark):
    """All vectors lie in a narrow cone, so most signs agree and buckets are large; pairs are told apart by further signs."""
    rng = np.random.default_rng(12)
    x = spread(rng, 4000, 48, 100, 0.19) + 3.0 * np.eye(48)[0]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    rows = [(k, [float(y) for y in v], 1) for k, v in enumerate(x)]
    sim = (np.array(x, np.float32).astype(float) @ np.array(x, np.float32).astype(float).T) / np.outer(*[np.sqrt((np.array(x, np.float32).astype(float) ** 2).sum(1))] * 2)
    linked = (sim >= 0.997).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_duplicates(table(spark, x), threshold=0.997).collect()}
    assert len(rows) == len(got) and linked.sum() >= 200
    assert sum(got.values()) >= 0.99 * linked.sum() and all(got[k] <= linked[k] for k in got)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 5)], [(1, None, None)]])
def test_few_rows(spark, rows):
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert [tuple(x) for x in got] == [(1, 0, 1, True) for _ in rows]


def test_components_and_buckets_of_several_blocks(spark, monkeypatch):
    """Blocks of eight, so that families and buckets are dealt into many."""
    from tessitura.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    rows = []
    for label in (0, 1):
        for size in (90, 30, 1):
            centre = rng.normal(size=8)
            for _ in range(size):
                rows.append((len(rows), [float(x) for x in centre + 0.08 * rng.normal(size=8)], label))
        for _ in range(60):
            rows.append((len(rows), [float(x) for x in rng.normal(size=8)], label))
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)).collect()
    assert sorted(str((x.vec_id, x.n_links, x.component_id, x.kept)) for x in got) == brute(rows)
