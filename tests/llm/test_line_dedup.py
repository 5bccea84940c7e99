import random

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm.line_dedup import OP3_SQL, deduplicated, half_keys, near, op3_line_dedup, variants, word_lines
from tessitura.llm.shared import raw_text
from tessitura.llm.words import Sequences

WORDS = st.lists(st.sampled_from("abc"), max_size=7)


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row = _next(row, i, a, y)
    return row[-1]


def _next(row, i, a, y):
    out = [i]
    for j, b in enumerate(y, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (a != b)))
    return out


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS)
def test_near_halves_and_variants(x, y):
    within = distance(x, y) <= 1
    assert near(x, y) == within
    code = [np.array([ord(c) * 7919 for c in w], np.uint64) for w in (x, y)]
    sums = [Sequences(c) for c in code]
    a = np.array([0])
    if within and x and y and x != y and min(len(x), len(y)) > 1:
        keys = [set(half_keys(s, a, np.array([len(c)])).ravel().tolist()) for s, c in zip(sums, code, strict=True)]
        assert keys[0] & keys[1]
    if len(x) > 0 and len(y) > 0:
        v = [variants(s, a, np.array([len(c)]))[2][1:].tolist() for s, c in zip(sums, code, strict=True)]
        h = [int(s.spans(a, np.array([len(c)]))[0]) for s, c in zip(sums, code, strict=True)]
        told = h[0] in v[1] or h[1] in v[0] or (len(x) == len(y) and any(p == q for p, q in zip(*v, strict=True))) or h[0] == h[1]
        assert told == within


def test_word_lines():
    data, at = raw_text(pa.array(["a b\n\n c", "", "d\n"]))
    _, a, b, first = word_lines(data, at)
    assert (b - a).tolist() == [2, 0, 1, 0, 1, 0] and first.tolist() == [0, 3, 4, 6]


def brute(rows, least, near_words):
    seen, out = [], {}
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    for last, i, t in order:
        kept = []
        for line in t.split("\n"):
            w = line.encode().lower().split()
            gone = len(w) >= least and any(v == w or min(len(v), len(w)) >= near_words and distance(v, w) <= 1 for v in seen)
            seen.append(w)
            if not gone:
                kept.append(line)
        out[(None if last else i, t)] = "\n".join(kept)
    return sorted(str((i, out.get((i, t)))) for i, t in rows)


def test_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = ["Ab", "cd", "é", "fg,", "Hi", "jk"]
    pool = [[r.choice(vocabulary) for _ in range(r.randint(0, 12))] for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "\n\n")]
    for k in range(4, 60):
        text = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                where = r.randint(0, len(w))
                w[where : where + r.randint(0, 1)] = r.choice([[], ["xx"], ["jk"]])
            text.append((" " if r.random() < 0.8 else "\t ").join(w))
        rows.append((k, "\n".join(text)))
    rows += [rows[10], rows[20], (None, rows[30][1] + "\na b c d e f g h i j k l m")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, line int").repartition(4)
    got = deduplicated(docs, 3, 6, counts=True)
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_equal", "n_near"]
    assert sorted(str((x.doc_id, x.text)) for x in got.collect()) == brute(rows, 3, 6)


def test_production_values_against_brute_force(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    pool = [[r.choice(words) for _ in range(n)] for n in range(1, 14) for _ in range(3)]
    rows = []
    for k in range(70):
        text = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 1, 1, 2])):
                where = r.randint(0, len(w))
                w[where : where + r.randint(0, 1)] = r.choice([[], ["xx"], ["W3"]])
            text.append(" ".join(w))
        rows.append((k, "\n".join(text)))
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(str((x.doc_id, x.text)) for x in got.collect()) == brute(rows, 4, 5)


def test_empty_table(spark):
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = op3_line_dedup(spark, sf)
    want = con.execute(OP3_SQL)
    assert [d[0] for d in want.description] == got.columns
    want = sorted(want.fetchall())
    assert sorted(tuple(x) for x in got.collect()) == want
    assert sum(x[2] for x in want) > 1000 and sum(x[3] for x in want) > 50
