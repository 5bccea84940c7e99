import random

import numpy as np
import pytest

from tessitura.llm.components import components
from tessitura.llm import ngram_join
from tessitura.llm.ngram_join import Order, band_segments, folded, index, limits, near_duplicates, one_of_each, sketches


def test_every_linked_pair_shares_an_entry():
    rng = np.random.default_rng(3)
    checked = 0
    for trial in range(3000):
        n = int(rng.integers(1, [8, 40, 300][trial % 3]))
        a = set(rng.integers(0, 2**64, n, dtype=np.uint64).tolist())
        b = set(a)
        for _ in range(int(rng.integers(0, n // 4 + 2))):
            if rng.random() < 0.5 and b:
                b.discard(random.Random(trial).choice(sorted(b)))
            else:
                b.add(int(rng.integers(0, 2**63)))
        if not b or a == b or 100 * len(a & b) < 80 * len(a | b):
            continue
        checked += 1
        sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
        both, at = np.concatenate(sets), np.array([0, len(a), len(a) + len(b)])
        shuffled = Order({k: rng.random(500) for k in range(len(limits(600, 80)))}) if trial % 2 else None
        if shuffled:
            shuffled.places = {k: v[v < band_segments(limits(10**6, 80), np.array([k]), 80)[0]] for k, v in shuffled.places.items()}
        keys, owner = index(both, at, 80, shuffled)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (len(a), len(b), len(a & b))
    assert checked > 500


def test_bitmaps_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        common = rng.integers(0, 2**64, rng.integers(0, 300), dtype=np.uint64).tolist()
        a, b = ({*common, *rng.integers(0, 2**64, rng.integers(1, 80), dtype=np.uint64).tolist()} for _ in "ab")
        words, at = sketches(np.array(sorted(a) + sorted(b), np.uint64), np.array([0, len(a), len(a) + len(b)]))
        rows = [words[at[k] : at[k + 1]].view(np.uint64)[None, :] for k in (0, 1)]
        bits = int(np.bitwise_count(np.bitwise_xor(*(folded(x, min(y.shape[1] for y in rows)) for x in rows))).sum())
        assert bits <= len(a ^ b) and (bits > 0 or len(a ^ b) % 2 == 0)


def brute(rows, percent=80):
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[j]:
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    least = {}
    for v, (d, _), s in zip(label, rows, sets, strict=True):
        if s and d is not None:
            least[v] = min(least.get(v, d), d)
    return sorted(str((d, len(s), least.get(v) if s else d)) for v, (d, _), s in zip(label, rows, sets, strict=True))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    out = [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two\tWORDS"), (6, "a b c d"), (7, "é É x y z q"), (8, "É é x y z q"), (None, "null id text of some six words"), (9, "null id text of some six words")]
    k = 10
    for size in (5, 9, 14, 30, 60, 150):
        for _ in range(5):
            base = [r.choice(vocabulary) for _ in range(size)]
            for _ in range(6):
                out.append((k, " ".join(base)))
                k += 1
                base = list(base)
                for _ in range(r.randint(0, 1 + size // 40)):
                    base[r.randrange(size)] = r.choice(vocabulary)
                if r.random() < 0.5:
                    base = base + [r.choice(vocabulary) for _ in range(size // 20)]
    # One group in which only neighbours link, copies of a member, and a passage that many texts share.
    chain = [f"c{i}" for i in range(200)]
    out += [(k + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(20)]
    out += [(k + 20 + i, " ".join(chain[:100])) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(30))
    out += [(k + 100 + i, passage + " " + " ".join(r.choice(vocabulary) for _ in range(i % 9))) for i in range(60)]
    return out


def test_near_duplicates_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, class int").repartition(5)
    got = near_duplicates(docs).collect()
    assert sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in got) == brute(rows)


def test_a_group_makes_fewer_links_than_it_has_classes(spark):
    """90 classes, each its own component, in three families of which all pairs link: 1,305 pairs of close classes in the first
    group, whose links join them to three; the second compares one half of a family with the other."""
    r = random.Random(4)
    family = [[r.getrandbits(63) for _ in range(200)] for _ in range(3)]
    sets = [np.array(sorted(family[k % 3][:190] + [r.getrandbits(63) for _ in range(k % 7)]), np.uint64) for k in range(90)]
    held = spark.createDataFrame([(k, len(s), s.view(np.int64).tolist(), sketches(s, np.array([0, len(s)]))[0].tolist()) for k, s in enumerate(sets)], "class long, n long, grams array<long>, sketch array<long>")
    rows = [(1, k, len(sets[k]), k, True, True) for k in range(90)] + [(2, k, len(sets[k]), k, k < 45, k >= 45) for k in range(0, 90, 3)]
    groups = spark.createDataFrame(rows, "g long, class long, n long, component long, first boolean, second boolean")
    for g, few in ((1, 87), (2, 29)):
        got = ngram_join._more_links(groups.where(f"g = {g}"), held, 80).collect()
        assert len(got) == few and all(x.a < x.b and x.a % 3 == x.b % 3 for x in got)
        label = {x.node: x.component for x in components(spark.createDataFrame(got)).collect()}
        assert set(label.values()) == ({0, 1, 2} if g == 1 else {0}) and len(label) == (90 if g == 1 else 30)


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Texts that link with few of those they share entries with, in blocks of a few classes or shingles."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        text = [f"b{k}" for k in range(60)]
        for p in r.sample(range(60), 1 + i % 2):
            text[p] = f"x{i}"
        rows.append((i, " ".join(text)))
    for name, value in (("BLOCK", 9), ("SHINGLES", 500)):
        with monkeypatch.context() as m:
            m.setattr(ngram_join, name, value)
            got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(str((x.doc_id, x.n_shingles, x.component_id)) for x in got) == brute(rows)
    assert len({x.component_id for x in got}) > 10


def test_one_of_each(spark, rows):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, mark int")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    alone = [x for x in brute(rows) if x.split(", ")[0][1:] == x.split(", ")[2][:-1] or ", 0, " in x]
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(x.split(", ")[0][1:] for x in alone)


def test_one_of_each_repeated_row(spark):
    text = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcde"]
    rows = [(1, text[0]), (1, text[0]), (1, text[0] + " more"), (2, text[0]), (3, text[1]), (3, text[2])]
    rows += [(None, text[3]), (None, text[3]), (None, text[3] + " more"), (None, text[4]), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component int").repartition(3)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(str((x.doc_id, (x.text or "")[:2])) for x in kept.collect())
    assert got == sorted(str(x) for x in [(1, "a0"), (3, "b0"), (3, "c0"), (None, "d0"), (None, "e0"), (4, ""), (4, ""), (None, "")])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)]
    label = {n: n for e in links for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = components(spark.createDataFrame([*links, (None, 5)], "a long, b long"))
    assert {x.node: x.component for x in got.collect()} == label
    assert got.count() == len(label)
