import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tessitura.llm.spelling import OP12_SQL, near_words, op12_spelling_variants, variants, word_counts

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words, ratio=10):
    form, out = {}, {}
    for w, n in words.items():
        own = sorted((-m, v) for v, m in words.items() if near(w, v))
        form[w] = own[0] if own and -own[0][0] >= ratio * n else None
        out[w] = len(own)
    result = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root][1]
        result.add((w, form[w] and form[w][1], root, n, out[w], form[w] and -form[w][0]))
    return result


def made(rows):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("group", [500, 3, 1])
def test_against_all_pairs(spark, group):
    """Also where many words share halves, so that groups of agreeing entries are told apart further."""
    random.seed(group)
    words = {"".join(random.choice("ab") for _ in range(random.randint(7, 9))): random.choice((2, 3, 30, 400, 5000)) for _ in range(150)}
    words |= {"preface" + "".join(random.choice("xyé") for _ in range(random.randint(1, 4))): random.choice((2, 25, 300)) for _ in range(80)}
    words |= {"a" * 40: 2, "a" * 41: 20, "a" * 39 + "b": 200, "a" * 20 + "c" + "a" * 20: 2, "ÿ" * 7: 5, "ÿ" * 8: 50}
    got = variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), group=group).collect()
    assert len(got) == len(words) and made(got) == plain(words)


def test_pairs_come_once(spark):
    words = spark.createDataFrame([("aaaaaaaa", 2), ("aaaaaaa", 2), ("aaaaaaab", 9)], "word string, n long")
    assert sorted((r.a, r.b) for r in near_words(words).collect()) == [("aaaaaaa", "aaaaaaaa"), ("aaaaaaa", "aaaaaaab"), ("aaaaaaaa", "aaaaaaab")]


def test_long_chain(spark):
    """Eleven words, each ten times as frequent as the one before it and one letter away."""
    words = {"b" * k + "a" * (11 - k): 2 * 10**k for k in range(12)}
    got = variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.root for r in got} == {"b" * 11} and made(got) == plain(words)


def test_words_of_odd_rows(spark):
    texts = [(1, "Éléphant éléphant ÉLÉPHANT elephant"), (2, None), (3, ""), (None, "nothing nothing nothing"), (4, "repeated sevenxx"), (4, "repeated sevenxx"), (5, "a×bcdefg÷ a×bcdefg÷ naïve-looking looking42looking"), (6, "letters " * 20_000)]
    rows = spark.createDataFrame([(i, t, 3, "x") for i, t in texts], "doc_id long, text string, n long, word string")
    for dropped in (None, 2):
        want = Counter()
        for i, t in texts:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{i}:{run}".encode())
                if dropped and i is not None and h % dropped == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                want[run] += len(run) >= 7
        got = {r.word: r.n for r in word_counts(rows, dropped=dropped).collect()}
        assert got == {w: n for w, n in want.items() if n >= 2} and got
    assert variants(word_counts(rows.limit(0))).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    own = con.execute(OP12_SQL)
    names = [d[0] for d in own.description]
    want = Counter(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in own.fetchall())
    got = op12_spelling_variants(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want
    assert got.where("form is not null").count() > 5
