import json
from datetime import datetime

import numpy as np
import pytest

from tessitura.operators.audio import levelled, loudness, samples_of, trimmed, with_audio
from tessitura.operators.generation import HashGenerator, generated, materialised
from tessitura.operators.matching import matched, split
from tessitura.operators.midi import with_midi
from tessitura.operators.statistics import failures_as_requested, output_files, run_statistics, run_times
from tessitura.plans.run import arguments, main, run
from tessitura.plans.session import session
from tessitura.sources.prompts import audio_files, chosen, given, id_list, lines_of, require_file

def midi_of(spark, tokens):
    return bytes(with_midi(spark.createDataFrame([(tokens,)], "tokens array<int>")).first().midi)


OUTCOMES = "prompt_idx long, output_idx int, requested int, secs double, ok boolean, path string"


def test_prompt_file(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes("alpha\t \r\n   \n\xa0beta\xa0\n\ngamma\rdelta\x1c\n".encode())
    assert [tuple(r) for r in lines_of(spark, str(tmp_path / "p.txt")).collect()] == [(1, "alpha"), (2, "beta"), (3, "gamma"), (4, "delta")]


def test_chosen(spark, tmp_path):
    (tmp_path / "p.txt").write_text("x\n")
    assert chosen(spark, "a").collect() == given(spark, "a").collect()
    assert chosen(spark, None, str(tmp_path / "p.txt")).first().prompt == "x"
    assert chosen(spark, interactive=True) is None
    for bad in (("a", "b"), (None, None)):
        with pytest.raises(ValueError):
            chosen(spark, *bad)


def test_files_and_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("f" * 32 + "\n" + "0a" * 16 + " \nnot an id\n" + "f" * 32 + "\n")
    assert sorted(r.id for r in id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["0a" * 16, "f" * 32]
    assert require_file(spark, str(tmp_path / "ids.txt"))
    with pytest.raises(FileNotFoundError):
        require_file(spark, str(tmp_path / "none.sf2"))


def test_statistics(spark):
    rows = [(1, 1, 3, 9.0, True, "1/a.mid"), (1, 2, 3, 9.0, False, "1/b.mid"), (2, 1, 2, 2.0, True, "2/a.mp3"), (2, 1, 2, 2.0, True, "2/a.mid"), (3, 1, 1, 4.0, False, "3/a.mid")]
    out = spark.createDataFrame(rows, OUTCOMES)
    assert tuple(run_statistics(out).first()) == (3, 3, 2, 2, 3.0)
    assert {r.prompt_idx: r.failed_generations for r in failures_as_requested(out).collect()} == {1: 2, 2: 0, 3: 1}
    assert {r.prompt_idx: r.files for r in output_files(out, "prompt_idx").collect()} == {1: "1/a.mid", 2: "2/a.mid,2/a.mp3"}
    assert run_statistics(out.where("prompt_idx = 1")).first().average_time == 0.0
    assert tuple(run_statistics(out.limit(0)).first()) == (0, 0, 0, 0, 0.0)


def test_run_times(spark):
    rows = [("a", datetime(2025, 1, 1, 10, 0, 0), 5.0), ("a", datetime(2025, 1, 1, 10, 0, 2), 1.5), ("b", datetime(2025, 1, 1, 9, 0, 0), 0.25), ("b", None, 9.0), ("b", datetime(2025, 1, 1, 8, 0, 0), None), ("c", None, None)]
    out = spark.createDataFrame(rows, "run string, began timestamp, secs double")
    assert {r.run: r.total_time for r in run_times(out, "run").collect()} == {"a": 5.0, "b": 0.25}
    assert run_times(out.limit(0), "run").count() == 0


def test_matching(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id long, text string"), spark.createDataFrame([(1, b"m"), (3, b"n")], "id long, midi binary")
    assert [r.id for r in matched(a, b).collect()] == [1]
    held = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert sorted((r.text, r.part) for r in split(a, held).collect()) == [("x", "eval"), ("y", "train"), ("z", "train")]


def test_generated_is_written_once(spark, tmp_path):
    rows = materialised(generated(given(spark, "a", "b"), n_outputs=2, max_tokens=30), str(tmp_path))
    got = rows.collect()
    assert sorted((r.prompt_idx, r.output_idx) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert got == rows.collect() and all(r.requested == 2 and len(r.tokens) <= 30 and min(r.tokens) >= 0 for r in got)


def test_run(spark, tmp_path):
    class Crowd(HashGenerator):
        """Fails the density rule in its second output."""

        def sample(self, ids, n, temperature, top_p, max_tokens):
            out = super().sample(ids, n, temperature, top_p, max_tokens)
            return [out[0], [128256 + x for x in [1, 10005, 11060] * 65], *out[2:]]

    now, said = datetime(2025, 1, 2, 3, 4, 5), []
    stats = run(spark, given(spark, "first é", "second"), str(tmp_path), now, make=Crowd, n_outputs=3, write=said.append)
    root = tmp_path / "2025-01-02_030405"
    names = sorted(p.name for p in (root / "20250102_030405_prompt_1").iterdir())
    assert names == ["gen_1.mid", "gen_1_tokens.txt", "gen_3.mid", "gen_3_tokens.txt", "prompt.txt"]
    own = root / "20250102_030405_prompt_2"
    assert (root / "20250102_030405_prompt_1" / "prompt.txt").read_text("utf-8") == "first é"
    tokens = (own / "gen_3_tokens.txt").read_text()
    assert tokens.endswith("\n") and midi_of(spark, [int(x) for x in tokens.split()]) == (own / "gen_3.mid").read_bytes()
    saved = json.loads((root / "generation_stats.json").read_text())
    assert {k: v for k, v in stats.items() if k != "timed_prompts"} == {k: v for k, v in saved.items() if k not in ("generation_times", "output_files")}
    assert saved["total_prompts"] == 2 and saved["successful_generations"] == 4 and saved["failed_generations"] == 2
    assert len(saved["generation_times"]) == 1 and [p.split("/")[1] for p in saved["output_files"]] == ["gen_1.mid", "gen_3.mid"] * 2
    assert "  MIDI: 20250102_030405_prompt_1/gen_1.mid" in said and said[1] == "prompts: 2"
    assert sorted(p.name for p in root.iterdir()) == ["20250102_030405_prompt_1", "20250102_030405_prompt_2", "generation_stats.json"]


def test_main(spark, tmp_path):
    a = arguments(["--prompt", "x"])
    assert (a.n_outputs, a.temperature, a.top_p, a.max_tokens, a.synthesize, a.gpu_memory) == (4, 1.0, 0.98, 2046, True, 0.9)
    with pytest.raises(SystemExit):
        arguments(["--prompt", "x", "--prompts_file", "y"])
    own = ["--n_outputs", "1", "--output_root", str(tmp_path)]
    said, asked = [], iter([" second ", "third", ""])
    stats = main(spark, ["--prompt", "x", "--no-synthesize", "--interactive", *own], read=lambda _: next(asked), write=said.append)
    assert stats["total_prompts"] == 1 and stats["average_time"] == 0 and not stats["config"]["fp8"]
    assert said[:2] == ["=" * 60, "prompts: 1"] and "second: 1 of 1 outputs" in said
    session, = tmp_path.iterdir()
    assert sorted(p.name.split("_prompt_")[1] for p in session.glob("*_prompt_*")) == ["1", "2", "3"]
    assert not list(session.glob("_work*"))

    def ended(_):
        raise EOFError

    assert main(spark, ["--interactive", "--no-synthesize", *own], read=ended, write=said.append) is None
    for bad in (["--fp8"], ["--gpu_memory", "0.5"], ["--cache_dir", "x"], ["--model", "unknown"]):
        with pytest.raises(ValueError):
            main(spark, ["--prompt", "x", "--no-synthesize", *own, *bad])
    with pytest.raises(FileNotFoundError):
        main(spark, ["--prompt", "x", *own, "--soundfont", str(tmp_path / "none.sf2")])
    (tmp_path / "a.sf2").touch()
    with pytest.raises(ValueError, match="renderer"):
        main(spark, ["--prompt", "x", *own, "--soundfont", str(tmp_path / "a.sf2")])


def test_audio(spark, tmp_path):
    class Tone:
        kind = "wav"

        def render(self, midi):
            if midi.endswith(b"\x00" * 99):
                raise RuntimeError("no")
            quiet, loud = np.zeros(9000), 3 * np.sin(np.arange(20000) / 9)
            return np.concatenate([quiet, loud, quiet]), 22050

    stats = run(spark, given(spark, "a"), str(tmp_path), datetime(2025, 1, 2, 3, 4, 5), n_outputs=2, renderer=Tone)
    own = tmp_path / "2025-01-02_030405" / "20250102_030405_prompt_1"
    assert stats["successful_generations"] == 2
    saved = json.loads((own.parent / "generation_stats.json").read_text())
    assert saved["generation_times"] == [] and [p.rpartition("/")[2] for p in saved["output_files"]] == ["gen_1.mid", "gen_1.wav", "gen_2.mid", "gen_2.wav"]
    samples, rate = samples_of((own / "gen_1.wav").read_bytes())
    assert rate == 22050 and 20000 <= len(samples) <= 20000 + 3 * 2048 and loudness(samples, rate) == pytest.approx(-18, abs=0.1)
    assert [r.content for r in audio_files(spark, str(own)).where("path like '%gen_2.wav'").collect()] == [(own / "gen_2.wav").read_bytes()]
    rows = spark.createDataFrame([(1, bytearray(99), True), (2, bytearray(b"x"), False), (3, bytearray(b"x"), True)], "k int, midi binary, ok boolean")
    got = {r.k: (r.audio_status, r.audio is None) for r in with_audio(rows, Tone).collect()}
    assert got == {1: ("error: no", True), 2: ("skipped", True), 3: ("rendered", False)}


def test_level():
    x = np.array([0.5, -2.0, 1.0])
    assert levelled(x, 1, None).tolist() == [0.25, -1.0, 0.5]
    assert levelled(x / 4, 1, lambda *_: -12.0).tolist() == pytest.approx((x / 4 * 10 ** (-6 / 20)).tolist())
    assert len(trimmed(np.zeros(9000))) == 0


def test_unchecked_outputs_are_kept(spark, tmp_path):
    class Crowd(HashGenerator):
        def sample(self, ids, n, *_):
            return [[128256 + x for x in [1, 10005, 11060] * 65]] * n

    for validate, good in ((True, 0), (False, 2)):
        stats = run(spark, given(spark, "a"), str(tmp_path / str(validate)), make=Crowd, n_outputs=2, validate=validate)
        assert stats["successful_generations"] == good


def test_large_prompt_file(spark, tmp_path):
    lines = [f"prompt {k}" if k % 7 else " " for k in range(60_000)]
    (tmp_path / "p.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = lines_of(spark, str(tmp_path / "p.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.prompt for r in sorted(got)] == [x for x in lines if x.strip()] and sorted(r.prompt_idx for r in got) == list(range(1, len(got) + 1))


def test_session(spark):
    assert session("other").conf.get("spark.sql.session.timeZone") == "UTC"
