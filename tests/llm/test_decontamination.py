import hashlib
import random
import re
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessitura.llm.decontamination import SuffixAutomaton, automata, decontaminated, marked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    ws, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(window, len(iw))
        for g in {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else ():
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) == g:
                    hit.update(range(k, k + n))
                    found.add(str(name))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=12), min_size=1, max_size=5), st.text("abc", max_size=30), st.integers(1, 5))
def test_automaton_against_brute_force(items, text, window):
    import numpy as np

    code = {"a": 1, "b": 2, "c": 3}
    automaton = SuffixAutomaton([(str(i), [code[c] for c in t]) for i, t in enumerate(items)], window)
    got = automaton.matches(np.array([code[c] for c in text], np.uint64), np.array([0, len(text)]))
    hit = {k for spans, _ in got.values() for a, b in spans for k in range(a, b)}
    want = brute(" ".join(text), [(i, " ".join(t)) for i, t in enumerate(items)], window)
    assert len(hit) == want[1]
    assert sorted({x for _, names in got.values() for x in names}) == sorted(str(i) for i, t in enumerate(items) if t and brute(" ".join(text), [(i, " ".join(t))], window)[4])


ITEMS = [(1, "one two three four five six"), (2, "Zwei, drei vier fünf sechs sieben"), (3, "lone"), (4, None), (5, "..."), (1, "one two three four five six")]
TEXTS = [
    (1, "x one TWO three, four y"),
    (2, "a b zwei drei\nvier fünf sechs z"),
    (3, None),
    (4, ""),
    (5, "LONE and lone"),
    (5, "LONE and lone"),
    (None, "two three four five six seven " * 50),
    (7, "two three one two three"),
]


@pytest.mark.parametrize("block_words", [100_000, 4])
def test_marked(spark, block_words):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = marked(docs, items, 4, block_words=block_words).collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(doc_id=i, n_words=w, n_hit=h, n_items=n, items_sha256=s, contaminated=c) for i, t in TEXTS for w, h, n, s, c in [brute(t, ITEMS, 4)]]))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert marked(docs, items).count() == 0
    one = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert not marked(one, items.limit(0)).first().contaminated


def test_decontaminated(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([x for x in ITEMS if x[0] != 3], "item_id long, text string")
    got = decontaminated(docs, items, 4, 0.8)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "x  y" and rows[1].n_chars == 4
    assert rows[3].text is None and rows[4].text == "" and rows[5].text == "LONE and lone"
    assert None not in rows or not marked(got.where("doc_id is null"), items, 4).first().contaminated


def many_items():
    """Items of 3 to 60 words, some of them alike, and texts that hold parts of them."""
    r = random.Random(7)
    item = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(r.choice([3, 8, 12, 60])))) for k in range(60)]
    docs = []
    for k in range(80):
        parts = [f"x{r.randrange(9)}" for _ in range(20)]
        w = r.choice(item)[1].split()
        at, n = r.randrange(len(w)), r.choice([2, 5, 9, 30])
        docs.append((k, " ".join([*parts[:10], *w[at : at + n], *parts[10:]])))
    return item, docs


@pytest.mark.parametrize("kept", [4, 100])
def test_many_blocks_and_cut_items(spark, kept):
    items, texts = many_items()
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert automata(table, 5, 48).count() >= 15
    got = marked(docs, table, 5, block_words=48, kept=kept).collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(doc_id=i, n_words=w, n_hit=h, n_items=n, items_sha256=s, contaminated=c) for i, t in texts for w, h, n, s, c in [brute(t, items, 5)]]))
    assert sum(r.contaminated for r in got) > 20


def test_benchmark_is_read_once(spark, tmp_path):
    """Each time a row of the benchmark is read, a file is made; many blocks read each row once."""
    items, _ = many_items()

    def work(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                (tmp_path / uuid.uuid4().hex).touch()
            yield batch

    table = spark.createDataFrame(items, "item_id long, text string").mapInArrow(work, "item_id long, text string")
    assert automata(table, 5, 48).count() >= 15
    assert len(list(tmp_path.iterdir())) == len(items)


@pytest.mark.parametrize("coverage", [0.3, 0.8])
def test_rounds_cut_as_one_pass_does(spark, coverage):
    items, texts = many_items()
    # A cut brings the halves of an item together, which makes a window that no document word was in before.
    nested = items[0][1].split() if len(items[0][1].split()) > 8 else items[1][1].split()
    whole = next(t for _, t in items if len(t.split()) == 12)
    texts = [*texts, (900, " ".join(["y"] * 30 + nested[:4] + whole.split() + nested[4:8])), (901, whole), (902, ""), (903, None), (903, "x")]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, marked(docs, table, 5, max_coverage=coverage, block_words=b, kept=k).collect())) for b, k in ((100_000, 4), (150, 3)))
    assert one == many
