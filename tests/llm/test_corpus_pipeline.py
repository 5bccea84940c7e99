from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tessitura.llm.decontamination import marked
from tessitura.llm.ngram_join import near_duplicates
from tessitura.llm.shared import written
from tessitura.llm.tokens import encoded

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = written(stage(spark, docs, SF), name)
    return out


def rows(df):
    return {x.doc_id: x for x in df.collect()}


def test_columns(stages):
    names = stages["documents"].columns
    assert all(stages[k].columns == names for k in ("quality", "line_dedup", "near_dup", "decontam"))
    assert all(x.n_chars == len(x.text) for k in ("line_dedup", "near_dup", "decontam") for x in stages[k].collect())


def test_quality_keeps_good_documents(spark, stages):
    kept = rows(stages["quality"])
    label = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = ([x.doc_id in kept for x in label if x.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_line_dedup_leaves_the_earliest(stages):
    before, after = rows(stages["quality"]), rows(stages["line_dedup"])
    key = lambda line: tuple(line.encode().lower().split())
    often = Counter(key(x) for d in after.values() for x in d.text.split("\n") if len(key(x)) >= 4)
    assert max(often.values()) == 1
    first = {}
    for d in sorted(before):
        for x in before[d].text.split("\n"):
            first.setdefault(key(x), d)
    for d, x in after.items():
        was = before[d].text.split("\n")
        now = iter(was)
        assert all(line in now for line in x.text.split("\n"))
        assert all(first[key(line)] == d for line in x.text.split("\n") if len(key(line)) >= 4)
    # What went is equal to an earlier line, or a word away from one.
    for d, x in before.items():
        kept = Counter(after[d].text.split("\n")) if d in after else Counter()
        for line, n in (Counter(x.text.split("\n")) - kept).items():
            w = key(line)
            if len(w) >= 4 and first[w] == d and x.text.split("\n").count(line) == n:
                assert len(w) >= 10


def test_near_dup_leaves_one_of_each_group(stages):
    before, after = stages["line_dedup"], stages["near_dup"]
    group = {x.doc_id: x.component_id for x in near_duplicates(before).collect()}
    assert set(rows(after)) == {d for d, c in group.items() if d == c}


def test_decontam_leaves_no_window(spark, stages):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert marked(stages["decontam"], benchmark).where("contaminated").count() == 0
    hit = {x.doc_id for x in marked(stages["near_dup"], benchmark).where("contaminated").collect()}
    before, after = rows(stages["near_dup"]), rows(stages["decontam"])
    assert hit and all(after[d] == before[d] for d in before if d not in hit)


def test_packing_holds_every_document(stages):
    texts = rows(stages["decontam"])
    size = defaultdict(int)
    bins = defaultdict(list)
    for x in stages["packing"].collect():
        size[x.doc_id] += x.length
        bins[x.sequence_id].append((x.offset, x.length))
    ids = encoded([x.text for x in texts.values()])
    assert dict(size) == {d: len(i) + 1 for d, i in zip(texts, ids, strict=True)}
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
