import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessitura.operators.generation import HashGenerator
from tessitura.plans.run import save_statistics
from tessitura.sources.files import Store, write_files
from tessitura.streaming.interactive import answered, batch_files, incoming, numbered

SCHEMA = "path string, content binary"


def found(folder) -> dict[str, bytes]:
    """All files, hidden ones too."""
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def table(spark, files):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in files], SCHEMA).repartition(3)


def test_all_bytes(spark, tmp_path):
    files = [(f"a/{k}.bin", os.urandom(30) + bytes([k])) for k in range(0, 256, 17)]
    files += [("b/é x=1%'.txt", "naïve\r\nx".encode()), ("c/d/empty", b""), ("nl.txt", b"a\n\nb\n"), ("one", b"\x00"), ("big", bytes(range(256)) * 5000)]
    for root in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        write_files(table(spark, files), root)
        assert found(root.removeprefix("file://")) == dict(files)


def test_by_a_store_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "far").mkdir()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.sink.link./out", f"file://{tmp_path}/far")
    write_files(table(spark, [("a/x.mid", b"MThd\x00"), ("a/e", b"")]), "viewfs://sink/out/run", "mark")
    got = {p: c for p, c in found(tmp_path / "far").items() if not p.endswith(".crc")}
    assert got == {"run/a/x.mid": b"MThd\x00", "run/a/e": b"", "run/mark": b""}


def test_files_are_replaced(spark, tmp_path):
    write_files(table(spark, [("a", b"old"), ("b", b"kept")]), str(tmp_path))
    write_files(table(spark, [("a", b"new"), ("c", b"too")]), str(tmp_path))
    assert found(tmp_path) == {"a": b"new", "b": b"kept", "c": b"too"}
    write_files(table(spark, []), str(tmp_path))
    assert len(found(tmp_path)) == 3


@pytest.mark.parametrize("bad,said", [(("../no.txt", b"x"), "outside"), (("/no", b"x"), "outside"), (("a/../b", b"x"), "outside"), (("_staging-x", b"x"), "outside"), ((None, b"x"), "no path"), (("n", None), "no content"), (("a/1.txt", b"y"), "more than once")])
def test_failed_job_leaves_nothing(spark, tmp_path, bad, said):
    """Rows of one task, of which the last is refused, and of other tasks."""
    rows = table(spark, [("a/1.txt", b"x"), ("a/2.txt", b"x"), bad]).coalesce(1).union(table(spark, [("b/2.txt", b"y")]))
    with pytest.raises(Exception, match=said):
        write_files(rows, str(tmp_path / "out"))
    assert found(tmp_path) == {} and not list((tmp_path / "out").iterdir())


def test_failed_commit_takes_back_what_was_done(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"before")
    (tmp_path / "keep").write_bytes(b"kept")
    rows = table(spark, [("x", b"after"), ("y/z", b"one"), ("y/z/below a file", b"two"), *((f"more/{k}", b"m") for k in range(20))])
    with pytest.raises(Exception):  # noqa: B017  the file systems' own kind
        write_files(rows, str(tmp_path))
    assert found(tmp_path) == {"x": b"before", "keep": b"kept"}


def test_failed_task_leaves_nothing(spark, tmp_path):
    def broken(batches):
        for k, batch in enumerate(batches):
            yield batch
            raise RuntimeError("lost")

    rows = table(spark, [(f"f{k}", b"x") for k in range(50)])
    with pytest.raises(Exception, match="lost"):
        write_files(rows.mapInArrow(broken, SCHEMA), str(tmp_path))
    assert found(tmp_path) == {}


def test_statistics_of_many_outputs(spark, tmp_path):
    times = spark.range(2, 5001).select(F.col("id").alias("prompt_idx"), (F.col("id") / 8).alias("secs")).repartition(7)
    listed = spark.range(20_000).select((F.col("id") % 5000).alias("prompt_idx"), F.col("id").alias("output_idx"), F.lit(0).alias("rank"), F.format_string('p%d/"%d".mid', F.col("id") % 5000, F.col("id")).alias("path"))
    save_statistics({"total_prompts": 5000, "timed_prompts": 3, "config": {"model": "é"}}, times, listed, str(tmp_path))
    got = json.loads((tmp_path / "generation_stats.json").read_text("utf-8"))
    assert got["generation_times"] == [k / 8 for k in range(2, 5001)] and got["total_prompts"] == 5000 and got["config"] == {"model": "é"}
    assert got["output_files"] == [f'p{k % 5000}/"{k}".mid' for k in sorted(range(20_000), key=lambda k: (k % 5000, k))]
    save_statistics({"x": None}, times.limit(0), listed.limit(0), str(tmp_path))
    assert json.loads((tmp_path / "generation_stats.json").read_text()) == {"x": None, "generation_times": [], "output_files": []}


def lines(folder, name, *prompts):
    (folder / f".{name}").write_text("\n".join(prompts) + "\n")
    (folder / f".{name}").rename(folder / name)


def test_prompts_are_numbered_in_their_session(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    shared = F.regexp_extract("file", r"([a-z]+)\d*\.txt$", 1)
    for name, prompts in (("a.txt", ["same", "", "same", " x "]), ("a2.txt", ["same"]), ("b.txt", ["same", "é"])):
        lines(tmp_path / "in", name, *prompts)
        query = answered(numbered(incoming(spark, str(tmp_path / "in"), shared)), lambda df, _: seen.extend((r.session, r.prompt_idx, r.prompt) for r in df.collect()), str(tmp_path / "state"))
        assert query.awaitTermination(120)
    assert seen == [("a", 1, "same"), ("a", 2, "same"), ("a", 3, "x"), ("a", 4, "same"), ("b", 1, "same"), ("b", 2, "é")]


def test_killed_stream_writes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in", "s.txt", "twice", "twice")
    out = tmp_path / "out"
    handle = batch_files(str(out), "20250102_030405", n_outputs=2)

    def killed(batch, number):
        handle(batch, number)
        raise RuntimeError("killed before the batch was recorded")

    def stream(how):
        return answered(numbered(incoming(spark, str(tmp_path / "in"))), how, str(tmp_path / "state"))

    with pytest.raises(Exception, match="killed"):
        stream(killed).awaitTermination(120)
    first = {p: (out / p).stat().st_mtime_ns for p in found(out)}
    assert len([p for p in first if p.endswith(".mid")]) == 4
    assert stream(handle).awaitTermination(120)
    assert {p: (out / p).stat().st_mtime_ns for p in found(out)} == first
    lines(tmp_path / "in", "t.txt", "twice")
    assert stream(handle).awaitTermination(120)
    after = found(out)
    assert first.keys() < after.keys() and len([p for p in after if p.endswith("prompt.txt")]) == 3
    assert sorted(p.split("/")[1].rpartition("_")[2] for p in after if p.endswith("prompt.txt")) == ["1", "1", "2"]
    assert not [p for p in out.iterdir() if p.name.startswith(("_staging", "_work"))]


def test_batch_that_was_cut_off_is_written_again(spark, tmp_path):
    batch = spark.createDataFrame([("s", 1, "x")], "session string, prompt_idx long, prompt string")

    class Broken(HashGenerator):
        def sample(self, *_):
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        batch_files(str(tmp_path), "t", make=Broken)(batch, 0)
    assert found(tmp_path) == {}
    batch_files(str(tmp_path), "t", n_outputs=1)(batch, 0)
    assert len(found(tmp_path)) == 4 and Store(spark, str(tmp_path)).exists("_batches/stream/0")
