import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm.suffix_dedup import common_prefixes, suffix_array, without_repeats


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60).map(bytes) | st.binary(max_size=60))
def test_suffix_array_and_prefixes(raw):
    text = np.frombuffer(raw, np.uint8)
    order = suffix_array(text, 100)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    got = common_prefixes(text, order, 20).tolist()
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = 0
        while n < min(len(a), len(b), 20) and a[n] == b[n]:
            n += 1
        assert got[k] == n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.booleans()), max_size=60))
def test_suffix_array_of_wanted(pairs):
    text, wanted = np.array([c for c, _ in pairs], np.uint8), np.array([w for _, w in pairs], bool)
    raw = text.tobytes()
    order = [i for i in suffix_array(text, 100, wanted).tolist() if wanted[i]]
    assert order == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append(str((d, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"group": 2}, {"array_bytes": 300}])
def test_against_brute_force(spark, options):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefg é") for _ in range(n))
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 700), (5, "ab" * 300)]
    parts = [text(n) for n in (190, 199, 200, 201, 260, 500, 900)]
    k = 10
    for _ in range(60):
        rows.append((k, text(r.randint(0, 120)).join(r.choices(parts, k=r.randint(1, 3))) + text(r.randint(0, 300))))
        k += 1
    for _ in range(10):
        t = r.choice(rows[5:])[1]
        cut = r.randrange(len(t))
        rows += [(k, t[:cut] + r.choice("xyz") + t[cut:]), (k + 1, t), (k + 1, t), (None, t)]
        k += 2
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    got = sorted(str(tuple(x)) for x in without_repeats(docs, 200, **options).collect())
    assert got == brute(rows, 200)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
