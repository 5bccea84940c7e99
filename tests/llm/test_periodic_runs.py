import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm.runs import OP11_SQL, lyndon, op11_periodic_runs, runs_of, with_repetitions, word_runs

SF = "/root/testdata/sf0.001"


def plain(t, least):
    """All runs, by trying every period; a stretch that is one of a smaller period too is left out."""
    n, found = len(t), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and t[i] == t[i + q]:
                i += 1
            own = (a, i + q - a, q)
            if own[1] >= max(least, 2 * q) and not any(s <= a and s + m >= a + own[1] for s, m, _ in found):
                found.append(own)
    return sorted(found)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def zimin(n):
    t, k = [0], 0
    while len(t) < n:
        k += 1
        t = [*t, k, *t]
    return t


def families(n):
    random.seed(3)
    own = [random.randrange(2) for _ in range(300)]
    made = {
        "equal": [0] * n, "rising": list(range(n)), "fibonacci": fibonacci(n), "zimin": zimin(n), "random": [random.randrange(2) for _ in range(n)],
        "morse": [bin(i).count("1") & 1 for i in range(n)], "ruler": [(i & -i).bit_length() for i in range(1, n)], "last": [0] * (n - 1) + [1], "periodic": [0, 0, 0] + ([1] * 50 + [0]) * (n // 51),
        "longer": sum(([0] * k + [1] for k in range(int((2 * n) ** 0.5))), []), "cut": sum((own[: 200 + k % 100] + [2] for k in range(n // 250)), []),
    }
    t = [1]
    while len(t) < n:
        t = t + t + [0]
    return made | {"doubled": t}


def test_next_smaller_suffixes():
    for n in range(1, 11):
        for t in itertools.product((0, 1), repeat=n):
            following, _, compared = lyndon(list(t))
            assert following == [next((j for j in range(i + 1, n) if t[j:] < t[i:]), n) for i in range(n)]
            assert compared <= 3 * n


@pytest.mark.parametrize("name", families(10))
def test_words_compared_grow_with_the_length(name):
    for t in (families(20_000)[name], [-x for x in families(20_000)[name]]):
        assert lyndon(t)[2] <= 3 * len(t)
        assert runs_of(t, 12)[1] <= 12 * len(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 5), st.lists(st.integers(0, 2), max_size=14), st.sampled_from([2, 5, 12]))
def test_runs_against_all_periods(a, times, b, least):
    t = a * times + b
    assert runs_of(t, least)[0] == plain(t, least)


def test_texts_against_all_periods(spark):
    random.seed(11)
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 40), (4, "x y " * 30), (5, "a b c " * 5 + "a b"), (5, "a b c " * 5 + "a b"), (6, "word " * 30_000), (7, "é\x0bè\x0c" * 9), (8, "y" * 50_000 + " z")]
    for k in range(300):
        own = [random.choice("abcdefghij") * random.randint(1, 2) for _ in range(random.randint(1, 30))]
        noise = [random.choice("abcdefghijklmnop") for _ in range(random.randint(0, 60))]
        texts.append((100 + k, " ".join(noise + own * random.randint(1, 6) + noise[: random.randint(0, 60)] + own)))
    rows = spark.createDataFrame([(i, t, 7, "clash") for i, t in texts], "doc_id long, text string, n_words long, runs string").repartition(3)
    want = Counter()
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = plain(words, 12) if i != 6 else [(0, 30_000, 1)]
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want[i, len(words), tuple(found), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    got = word_runs(rows).collect()
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == want
    assert sum(len(r.runs) for r in got) > 200
    assert word_runs(rows.limit(0)).count() == 0


def test_repetitions(spark):
    docs = [(k, " ".join(f"w{j}" for j in range(k % 40))) for k in range(300)] + [(None, "a b"), (3, None)]
    got = Counter((r.doc_id, r.text) for r in with_repetitions(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = Counter()
    for i, t in docs:
        h = zlib.crc32(str(i).encode())
        if i is not None and t and h % 10 == 0:
            w, g = t.split(), h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join(x if k < a else w[a + (k - a) % p] for k, x in enumerate(w))
        want[i, t] += 1
    assert got == want


def test_against_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    own = con.execute(OP11_SQL)
    names = [d[0] for d in own.description]
    want = Counter(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in own.fetchall())
    got = op11_periodic_runs(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want
    assert got.where("n_runs > 0").count() > 10 and got.where(f"runs_sha256 = '{hashlib.sha256(b'').hexdigest()}'").count() > 100
