"""A whole run: prompts to files, statistics and a report."""

from __future__ import annotations

import argparse
import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.text import file_kind, output_path, prompt_directory
from tessitura.operators.audio import Renderer, with_audio
from tessitura.operators.generation import MAX_TOKENS, N_OUTPUTS, TEMPERATURE, TOP_P, generated, maker, materialised
from tessitura.operators.midi import with_midi
from tessitura.operators.notes import checked
from tessitura.operators.statistics import run_statistics
from tessitura.sources.files import generation_files, json_items, write_files, write_joined
from tessitura.sources.prompts import chosen, require_file

#: The defaults, names and statistics keys of the interface, also in `arguments` and `produce`.
SOUNDFONT, GPU_MEMORY = "./soundfonts/FluidR3_GM/FluidR3_GM.sf2", 0.9


def produce(spark: SparkSession, prompts: DataFrame, folder: str, stamp: str, validate: bool = True, renderer: Callable[[], Renderer] | None = None, use: Callable[[dict[str, Any], DataFrame, DataFrame], None] | None = None, **options) -> dict[str, Any]:
    """Writes <folder>/<stamp>_prompt_<i>/ and returns the counts and the average time. Generated rows are checked and rendered
    once, written to a folder of their own, and that is removed at the end. Before, `use` gets the counts and two tables:
    (prompt_idx, secs) of the timed prompts, and (prompt_idx, output_idx, rank, path) of the files."""
    outputs = checked(generated(prompts, **options), validate=validate)
    if renderer:
        outputs = with_audio(with_midi(outputs), renderer)
    work = f"{folder}/_work-{uuid.uuid4().hex}"
    try:
        outputs = materialised(outputs, work)
        if not renderer:
            outputs = with_midi(outputs)
        outputs = outputs.join(prompts, "prompt_idx").withColumn("directory", prompt_directory(stamp, F.col("prompt_idx")))
        write_files(generation_files(outputs), folder)
        listed = outputs.where("ok").select("prompt_idx", "output_idx", F.lit(0).alias("rank"), output_path(F.col("directory"), F.col("output_idx")).alias("path"))
        if renderer:
            sound = F.format_string("%s/gen_%d.%s", "directory", "output_idx", "audio_kind")
            listed = listed.union(outputs.where("ok and audio is not null").select("prompt_idx", "output_idx", F.lit(1), sound))
        times = outputs.where("prompt_idx > 1").groupBy("prompt_idx").agg(F.min("secs").alias("secs"))
        stats = run_statistics(outputs).first().asDict()
        if use:
            use(stats, times, listed)
    finally:
        removed(spark, work)
    return stats


def removed(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stamps(now: datetime | None = None) -> tuple[str, str]:
    """Of a session's folder, and of a prompt's."""
    now = now or datetime.now(timezone.utc)
    return now.strftime("%Y-%m-%d_%H%M%S"), now.strftime("%Y%m%d_%H%M%S")


def save_statistics(stats: dict[str, Any], times: DataFrame, listed: DataFrame, folder: str, name: str = "generation_stats.json") -> None:
    """The statistics file: counts and settings, the times in order of prompts, the files in order of prompt, output and kind.
    The lists are written in parts by tasks and joined, so a run of any size has room."""
    timed, any_time = json_items(times, F.col("secs"), "prompt_idx")
    files, any_file = json_items(listed, F.col("path"), "prompt_idx", "output_idx", "rank")
    rest = {k: v for k, v in stats.items() if k != "timed_prompts"}
    head = json.dumps(rest, indent=2).rstrip().removesuffix("}").rstrip() + ',\n  "generation_times": [\n'
    empty = times.sparkSession.createDataFrame([], "value string")
    write_joined([timed if any_time else empty, files if any_file else empty], folder, name, [head, '  ],\n  "output_files": [\n', "  ]\n}\n"])


def run(spark: SparkSession, prompts: DataFrame, output_root: str, now: datetime | None = None, validate: bool = True, config: dict[str, Any] | None = None, write: Callable[[str], None] | None = None, **options) -> dict[str, Any]:
    """Writes <root>/<session>/<stamp>_prompt_<i>/ and generation_stats.json, and the report, if `write` is given, line by line.
    Returns the counts, times summed up, and settings."""
    began = time.perf_counter()
    session, stamp = stamps(now)
    folder = f"{output_root.rstrip('/')}/{session}"

    def use(stats: dict[str, Any], times: DataFrame, listed: DataFrame) -> None:
        stats["total_time"] = time.perf_counter() - began
        stats["config"] = {"temperature": TEMPERATURE, "top_p": TOP_P, "max_tokens": MAX_TOKENS, "n_outputs": N_OUTPUTS} | (config or {})
        save_statistics(stats, times, listed, folder)
        for line in report(stats, listed) if write else ():
            write(line)

    return produce(spark, prompts, folder, stamp, validate, use=use, **options)


def interactive(spark: SparkSession, output_root: str, read: Callable[[str], str] = input, write: Callable[[str], None] = print, now: datetime | None = None, first: int = 1, **options) -> int:
    """One prompt after another from `read`, until an empty one or its end; the number of prompts. Prompts of a session are
    numbered on from `first`, so no two share a directory."""
    session, _ = stamps(now)
    folder, k = f"{output_root.rstrip('/')}/{session}", first

    def use(stats: dict[str, Any], times: DataFrame, listed: DataFrame) -> None:
        write(f"{prompt}: {stats['successful_generations']} of {stats['successful_generations'] + stats['failed_generations']} outputs")
        for row in in_order(listed):
            write(f"  {row['path']}")

    while True:
        try:
            prompt = read("Prompt: ").strip()
        except (EOFError, KeyboardInterrupt):
            break
        if not prompt:
            break
        produce(spark, spark.createDataFrame([(k, prompt)], "prompt_idx long, prompt string"), folder, stamps()[1], use=use, **options)
        k += 1
    write("end of the interactive session")
    return k - first


def in_order(listed: DataFrame) -> Iterator[Row]:
    """Rows of the list of files, fetched part by part."""
    return listed.orderBy("prompt_idx", "output_idx", "rank").toLocalIterator()


def report(stats: dict[str, Any], listed: DataFrame) -> Iterator[str]:
    yield "=" * 60
    yield f"prompts: {stats['total_prompts']}"
    yield f"good outputs: {stats['successful_generations']}"
    yield f"failed outputs: {stats['failed_generations']}"
    yield f"total: {stats['total_time']:.2f} s"
    if stats["timed_prompts"]:
        yield f"mean of a prompt: {stats['average_time']:.2f} s"
    for row in in_order(listed):
        yield f"  {'MIDI' if row['path'].endswith('.mid') else 'Audio'}: {row['path']}"


def listing(paths: DataFrame) -> DataFrame:
    return paths.select("path", file_kind(F.col("path")).alias("kind"))


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Token sequences from prompts, as MIDI files.")
    p.add_argument("--model", default="hash", help="a registered generator, or module:attribute; the built-in one is a stand-in")
    which = p.add_mutually_exclusive_group()
    which.add_argument("--prompt")
    which.add_argument("--prompts_file")
    p.add_argument("--output_root", default="./generated_outputs")
    p.add_argument("--n_outputs", type=int, default=N_OUTPUTS)
    p.add_argument("--no-synthesize", dest="synthesize", action="store_false")
    p.add_argument("--soundfont", default=SOUNDFONT)
    p.add_argument("--temperature", type=float, default=TEMPERATURE)
    p.add_argument("--top_p", type=float, default=TOP_P)
    p.add_argument("--max_tokens", type=int, default=MAX_TOKENS)
    p.add_argument("--cache_dir")
    p.add_argument("--interactive", action="store_true")
    p.add_argument("--fp8", action="store_true")
    p.add_argument("--gpu_memory", type=float, default=GPU_MEMORY)
    return p.parse_args(argv)


def main(spark: SparkSession, argv: list[str] | None = None, renderer: Callable[[], Renderer] | None = None, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> dict[str, Any] | None:
    """A run as arguments say, its report, and an interactive session after it if wanted. Audio takes a renderer, which the
    caller supplies, and the SoundFont must exist; options that nothing takes raise ValueError."""
    a = arguments(argv)
    prompts = chosen(spark, a.prompt, a.prompts_file, a.interactive)
    if a.synthesize:
        require_file(spark, a.soundfont)
        if renderer is None:
            raise ValueError("no renderer was given; --no-synthesize leaves audio out")
    make = maker(a.model, cache_dir=a.cache_dir, fp8=a.fp8, gpu_memory=None if a.gpu_memory == GPU_MEMORY else a.gpu_memory)
    config = {"model": a.model, "temperature": a.temperature, "top_p": a.top_p, "max_tokens": a.max_tokens, "n_outputs": a.n_outputs, "fp8": a.fp8}
    options = {"make": make, "n_outputs": a.n_outputs, "temperature": a.temperature, "top_p": a.top_p, "max_tokens": a.max_tokens, "renderer": renderer if a.synthesize else None}
    now, stats = datetime.now(timezone.utc), None
    if prompts is not None:
        stats = run(spark, prompts, a.output_root, now, config=config, write=write, **options)
    if a.interactive:
        interactive(spark, a.output_root, read, write, now, 1 + (stats["total_prompts"] if stats else 0), **options)
    return stats
