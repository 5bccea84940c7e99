import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm.token_counts import attributed, section_tokens
from tessitura.llm.tokens import encoded, encoder


def brute(text, spans, rule):
    """Tokens of each section of [start, end) in code points, those crossing, and those outside."""
    raw = text.encode()
    place = [len(text[:k].encode()) for k in range(len(text) + 1)]
    cut = [(place[min(a, len(text))], place[min(b, len(text))]) for a, b in spans]
    counts, crossing, outside, at = [0] * len(spans), [0] * len(spans), 0, 0
    for t in encoded([text])[0]:
        end = at + int(encoder().widths[t])
        held = [max(0, min(end, b) - max(at, a)) for a, b in cut]
        if not any(held):
            outside += 1
        else:
            k = held.index(max(held)) if rule == "most" else next(i for i, h in enumerate(held) if h)
            counts[k] += 1
            crossing[k] += held[k] < end - at
        at = end
    assert at == len(raw)
    return counts, crossing, outside


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.integers(0, 3), min_size=2, max_size=12), st.sampled_from(["most", "start"]))
def test_attributed(widths, cuts, rule):
    ends = np.cumsum(widths, dtype=np.int64)
    starts = ends - np.array(widths, np.int64)
    edges = np.cumsum(cuts)
    a, b = edges[:-1:2], edges[1::2]
    a = a[: len(b)]
    got, crossing = attributed(starts, ends, a, b, rule)
    for s, e, k, c in zip(starts, ends, got, crossing, strict=True):
        held = [max(0, min(e, y) - max(s, x)) for x, y in zip(a, b, strict=True)]
        if not any(held):
            assert k == -1 and not c
        else:
            assert k == (held.index(max(held)) if rule == "most" else next(i for i, h in enumerate(held) if h))
            assert c == (held[k] < e - s or sum(h > 0 for h in held) > 1)


TEXTS = [(1, "one line"), (2, "two\n\n\nlines é\n"), (3, ""), (4, None), (5, "\n"), (6, "word " * 3000 + "\n\n\n" + "émoji 😀😀\n" * 50), (6, "again\n \n x"), (None, "null id\nhere")]


def test_lines(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in TEXTS], "doc_id long, text string, start int")
    want = []
    for i, t in TEXTS:
        t = t or ""
        ends = [k + 1 for k, c in enumerate(t) if c == "\n"] + [len(t)]
        spans = list(zip([0, *ends], ends))
        counts, crossing, outside = brute(t, spans, "most")
        assert outside == 0 and sum(counts) == len(encoded([t])[0])
        want += [str((i, k, a, b, n, c)) for k, ((a, b), n, c) in enumerate(zip(spans, counts, crossing, strict=True))]
    assert sorted(str(tuple(x)) for x in section_tokens(docs).collect()) == sorted(want)


@pytest.mark.parametrize("rule", ["most", "start"])
def test_given_sections(spark, rule):
    text = "Header: ééé\nbody of some words\n\nfooter 😀 end"
    spans = [(0, 7), (9, 9), (10, 20), (20, 33), (35, 99)]
    docs = spark.createDataFrame([(1, text), (2, "no sections"), (3, None)], "doc_id long, text string")
    given_ = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(spans)] + [(9, 0, 0, 5)], "doc_id long, section int, start long, end long")
    got = {(x.doc_id, x.section): (x.n_tokens, x.n_crossing) for x in section_tokens(docs, given_, rule).collect()}
    counts, crossing, outside = brute(text, spans, rule)
    want = {(1, k): (n, c) for k, (n, c) in enumerate(zip(counts, crossing, strict=True))} | {(2, None): (len(encoded(["no sections"])[0]), 0)}
    if outside:
        want[1, None] = (outside, 0)
    assert got == want


def test_empty_table_and_rule(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert section_tokens(docs).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, rule="any")
