import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessitura.llm.packing import packed_documents, plan
from tessitura.llm.tokens import encoded

ODD = ["", None, " ", "a  b", "x \n y", "tab\t z", "<|endoftext|> end", "é\xa0 \xa0", "don't stop.  Go!", "\n\n a\n", " \xa0", "長い文 です", "a.b,c 's"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZ \n\t.,'s1é\xa0²　")), max_size=25), max_size=6))
def test_ids_are_the_librarys(texts):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_are_the_librarys, "t") else test_ids_are_the_librarys.t
    test_ids_are_the_librarys.t = reference
    assert [x.tolist() for x in encoded(texts)] == [reference.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30)), st.integers(2, 10), st.sampled_from(["dot", "norm"]))
def test_plan_keeps_every_constraint(counts, documents, score):
    rows = plan(counts, 40, documents, 1600, score)
    bins, taken = defaultdict(list), defaultdict(list)
    for length, lo, hi, first, offset in rows:
        for r in range(lo, hi):
            bins[first + r - lo].append((offset, length))
            taken[length].append(r)
    assert {k: sorted(v) for k, v in taken.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0
        assert sum(own[-1]) <= 40 and len(own) <= documents and sum(n * n for _, n in own) <= 1600


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_plan_is_near_the_least_number(score):
    """Against the bounds of tokens and of pieces over half a sequence, for lengths as of documents."""
    rng = np.random.default_rng(4)
    for scale in (60, 400, 900):
        length, n = np.unique(np.clip(rng.lognormal(np.log(scale), 0.9, 20_000), 2, 2048).astype(int), return_counts=True)
        rows = plan(dict(zip(length.tolist(), n.tolist(), strict=True)), 2048, score=score)
        used = max(first + hi - lo for _, lo, hi, first, _ in rows)
        least = max(-(-int((length * n).sum()) // 2048), int(n[length > 1024].sum()))
        assert used <= 1.01 * least + 1, (scale, used, least)


def test_limits_bind():
    counts = {10: 50, 30: 10}
    free, few, cheap = (max(first + hi - lo for _, lo, hi, first, _ in plan(counts, 100, *limits)) for limits in ((None, None), (3, None), (None, 1000)))
    assert free == 8 and few == 20 and cheap >= 14


def test_plan_refuses_too_long_a_piece():
    with pytest.raises(ValueError):
        plan({41: 1}, 40)


def test_packed_documents(spark, library):
    texts = [*ODD, *["word " * n for n in (3, 40, 41, 200)], *["same text"] * 30]
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packed_documents(docs, 64).collect()
    want = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // 64) - 1) * 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(i if i % 7 else None, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 64 + 1


def test_empty_table(spark):
    assert packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
