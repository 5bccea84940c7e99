import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from tessitura.llm.line_quality import _passes, fitted, learned, line_features, lines, marginals, op6_quality_classifier, scored
from tessitura.llm.shared import raw_text

SF = "/root/testdata/sf0.01"


def test_lines():
    data, at = raw_text(pa.array(["a\nbc\n", "", "\n", None, "xyz"]))
    starts, ends, first = lines(data, at)
    assert first.tolist() == [0, 3, 4, 6, 7, 8]
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"a", b"bc", b"", b"", b"", b"", b"", b"xyz"]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 5, 8])
    u, step = rng.normal(size=8), rng.normal(size=(2, 2))
    want = []
    for a, b in zip(first, first[1:]):
        total, good = 0.0, np.zeros(b - a)
        for ys in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(y * x for y, x in zip(ys, u[a:b])) + sum(step[i, j] for i, j in zip(ys, ys[1:])))
            total, good = total + p, good + p * np.array(ys)
        want += (good / total).tolist()
    assert np.allclose(marginals(u, first, step), want)
    ahead, back = _passes(u, first, np.argsort(-np.diff(first), kind="stable"), step)
    assert np.allclose(1 / (1 + np.exp(-(ahead + back))), want)


def test_learns_bad_lines():
    r = random.Random(1)
    clean = lambda: " ".join(r.choice(["lorem", "ipsum", "dolor", "amet"]) + str(r.choice("abcdef")) for _ in range(12)) + "."
    junk = lambda: "!!! $$$ ### " * 8
    texts, good = [], []
    for k in range(200):
        own = [clean() for _ in range(r.randint(2, 6))]
        if k % 4 == 0:
            own[r.randrange(len(own))] = junk() * 3
        texts.append("\n".join(own))
        good.append(k % 4 != 0)
    features, weight, first = line_features(*raw_text(pa.array(texts)))
    field = fitted(features, weight, first, np.array(good), rounds=60)
    got = field.scores(*raw_text(pa.array(["\n".join(clean() for _ in range(4)), junk() + "\n" + junk(), ""])))
    assert got[0] > 0.7 > got[1] and 0 <= got[2] <= 1


def test_held_out_accuracy(spark):
    rows = op6_quality_classifier(spark, SF).collect()
    label = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and x.predicted == (x.score >= 0.7) for x in rows)
    held = [(x.predicted, label[x.doc_id]) for x in rows if x.held_out and x.doc_id in label]
    assert sum(p == y for p, y in held) / len(held) > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "\n\n", 2.0), (2, "word " * 60_000, 2.0), (3, "x\ny" * 5, 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1), (9, 0)], "doc_id long, quality int")
    assert learned(docs, none) is None
    assert {x.score for x in scored(docs, none).collect()} == {0.5}
    both = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(1, None)], "doc_id long, quality int")
    got = scored(docs, both).collect()
    assert len(got) == 5 and all(0 <= x.score <= 1 for x in got)
    assert scored(docs.limit(0), both).count() == 0


def test_sample_is_bounded(spark):
    """Rows that repeat an id make the sample no larger, and a text beyond the bytes is left out whole."""
    good, bad = "a plain line of words\nand one more of them", "!!!! $$$$ 0000\n#### 1111 ////"
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(k, good if k % 2 else bad) for k in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    again = spark.createDataFrame(rows + rows[:1] * 500, "doc_id long, text string")
    one, other = learned(docs, labels), learned(again, labels)
    assert one.curve == other.curve and (one.unary == other.unary).all()
    long = spark.createDataFrame([*((k, t) for k, t in rows if k != ids[0]), (ids[0], good * 10_000)], "doc_id long, text string")
    less = learned(docs.where(f"doc_id <> {ids[0]}"), labels)
    assert (learned(long, labels, sample_bytes=10_000).unary == less.unary).all()
    assert learned(docs, labels, sample_bytes=10) is None
