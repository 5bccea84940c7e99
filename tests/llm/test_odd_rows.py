"""Odd tables through every pipeline stage, and strings whose polynomial hashes modulo 2**64 would agree."""

import hashlib
import os
import subprocess
import sys

import pytest

import corpus_pipeline
from tessitura.llm.decontamination import marked
from tessitura.llm.line_dedup import deduplicated
from tessitura.llm.ngram_join import near_duplicates
from tessitura.llm.packing import pieces
from tessitura.llm.suffix_dedup import without_repeats
from tessitura.llm.token_counts import section_tokens
from tessitura.llm.tokens import encoded, encoder

TEXT = "The committee met on Tuesday and agreed that the old bridge should be repaired before winter comes."
EXTRA = ("score", "predicted", "n_near", "n_equal", "_k", "_mark", "contaminated", "cleaned", "component", "mark", "class", "sequence_id", "_x0", "_row")


def opposites(k: int) -> tuple[str, str]:
    """The Thue-Morse word of 2**k letters and the one with its letters exchanged."""
    x = "a"
    for _ in range(k):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, TEXT), (None, "an item without id that has more than ten words in it for sure"), (3, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, folder, name, stage):
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in EXTRA)
    texts = [(1, TEXT), (1, TEXT), (2, None), (3, ""), (None, "no id " + TEXT), (None, None), (4, "word " * 30_000), (5, f"{TEXT}\n{TEXT}")]
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), *EXTRA) for i, t in texts], schema)
    got = stage(spark, docs, folder).collect()
    if name != "packing":
        assert all(tuple(x[n] for n in EXTRA) == EXTRA for x in got)
        assert stage(spark, docs, folder).columns == docs.columns
    if name in ("line_dedup", "near_dup", "decontam"):
        assert sum(x.text is None for x in got) == 2 and any(x.text == "" for x in got)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_opposites_are_different_words(spark):
    x, y = opposites(10)
    tail = " and some more words follow here so that there are shingles"
    docs = spark.createDataFrame([(1, x + tail), (2, y + tail)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert [got[k].component_id for k in (1, 2)] == [1, 1 if 100 * 7 >= 80 * 9 else 2]
    item = spark.createDataFrame([(1, x)], "item_id long, text string")
    assert [r.n_hit for r in marked(docs, item).orderBy("doc_id").collect()] == [1, 0]


def test_opposite_sequences_are_different_lines(spark):
    x, y = (" ".join(w) for w in opposites(11))
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string").coalesce(1)
    assert [(r.n_equal, r.n_near) for r in deduplicated(docs, counts=True).orderBy("doc_id").collect()] == [(0, 0), (0, 0), (1, 0)]


def test_opposites_share_only_what_they_share(spark):
    x, y = opposites(11)
    docs = spark.createDataFrame([(1, "<" + x[:1024]), (2, ">" + y[:1024])], "doc_id long, text string").coalesce(1)
    raw = ["<" + x[:1024], ">" + y[:1024]]
    starts = {}
    for d, t in enumerate(raw):
        for i in range(len(t) - 199):
            starts.setdefault(t[i : i + 200], []).append((d, i))
    hit = [set(), set()]
    for own in starts.values():
        if len(own) > 1:
            for d, i in own:
                hit[d].update(range(i, i + 200))
    got = without_repeats(docs).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [len(h) for h in hit]
    assert [r.kept_sha256 for r in got] == [hashlib.sha256("".join(c for i, c in enumerate(t) if i not in h).encode()).hexdigest() for t, h in zip(raw, hit, strict=True)]


def test_opposites_have_their_own_ids(spark):
    x, y = opposites(10)
    want = [encoder().special(t).tolist() for t in (x, y)]
    assert [i.tolist() for i in encoded([x, y])] == want and want[0] != want[1]
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string").coalesce(1)
    got = pieces(docs, with_ids=True).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [w + [0] for w in want]
    counted = {r.doc_id: r.n_tokens for r in section_tokens(docs).collect()}
    assert counted == {1: len(want[0]), 2: len(want[1])}


def test_more_automata_than_are_held(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before " + " ".join(f"w{k}x{j}" for j in range(12)) + " after") for k in range(60)], "doc_id long, text string").repartition(2)
    few, many = (sorted(map(str, marked(docs, items, max_coverage=0.9, block_words=b, kept=2).collect())) for b in (1000, 20))
    assert few == many and sum("contaminated=True" in x for x in many) == 40


def test_session_that_names_no_shared_folder(tmp_path):
    """A local session gets one temporary folder; a cluster's session is refused. A new process, as the setting of the tests'
    own session can't be taken back."""
    code = """
from pyspark.sql import SparkSession
from tessitura.llm import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
table = shared.written(spark.range(5), "x")
assert table.count() == 5 and shared.shared_dir(spark) in table.inputFiles()[0]
shared.discard(table)
class Far:
    conf = spark.conf
    class sparkContext:
        master, applicationId = "spark://host:7077", "far"
try:
    shared.shared_dir(Far)
except ValueError:
    print("refused")
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("refused"), done.stderr[-2000:]
