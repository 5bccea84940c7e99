"""Prompts that arrive as files: the unattended form of interactive sessions, numbered on in each and written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessitura.functions.text import prompt_directory, strip
from tessitura.operators.generation import generated, materialised
from tessitura.operators.midi import with_midi
from tessitura.operators.notes import checked
from tessitura.sources.files import Store, generation_files, write_files

ORDER = ["at", "file", "k"]


def incoming(spark: SparkSession, folder: str, session: Column | None = None, per_trigger: int | None = None) -> DataFrame:
    """session, prompt and their order (at, file, k): a stream of the stripped lines of text files in a folder, without blank
    ones. A session is a file, unless another column is given. `per_trigger` bounds the files of a micro-batch. Streams have
    no running number of rows, so a file is read as one row and its lines are numbered there."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger) if per_trigger else spark.readStream
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_modification_time", "at"), ("file_path", "file"))]
    rows = lines.option("wholetext", True).text(folder).select(*meta, F.posexplode(F.split("value", "\r\n|\r|\n")).alias("k", "line"))
    rows = rows.select("at", "file", F.col("k").cast("long").alias("k"), strip(F.col("line")).alias("prompt")).where("prompt <> ''")
    return rows.select((session if session is not None else F.col("file")).alias("session"), *ORDER, "prompt")


def numbered(prompts: DataFrame) -> DataFrame:
    """session, prompt_idx (from 1 in each session, on from one micro-batch to the next), prompt. A session's state is the number
    of its prompts so far, so equal lines get numbers of their own, also after a restart. The lines that a session gets in
    one micro-batch are put in order in one task."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(ORDER)
        state.update((before + len(rows),))
        yield pd.DataFrame({"session": key[0], "prompt_idx": range(before + 1, before + len(rows) + 1), "prompt": rows["prompt"].to_numpy()})

    return prompts.groupBy("session").applyInPandasWithState(count, "session string, prompt_idx long, prompt string", "n long", "append", GroupStateTimeout.NoTimeout)


def answered(prompts: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls `handle(batch, number)` for each micro-batch; with `once`, until what is there now is done."""
    writer = prompts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def session_folder(session: Column) -> Column:
    """A folder's name for a session: its last part in plain letters, and a digest that tells sessions of one name apart."""
    return F.concat(F.regexp_replace(F.regexp_extract(session, r"([^/]*)/*$", 1), r"[^A-Za-z0-9.-]+", "-"), F.lit("-"), F.substring(F.sha2(session, 256), 1, 12))


def batch_files(root: str, stamp: str, name: str = "stream", validate: bool = True, **options) -> Callable[[DataFrame, int], None]:
    """A handler for numbered prompts that generates and writes each micro-batch's files once, in
    <root>/<session>/<stamp>_prompt_<i>/. A batch that was written before the stream stopped, and is sent again when it
    restarts, is known by a mark that its files' commit leaves: `_batches/<name>/<number>`."""

    def handle(batch: DataFrame, number: int) -> None:
        mark = f"_batches/{name}/{number}"
        store = Store(batch.sparkSession, root)
        if store.exists(mark):
            batch.write.format("noop").mode("append").save()  # the counts of sessions go on as before
            return
        work = f"_work-{name}-{number}"
        store.delete(work)  # of an attempt that ended with its session
        try:
            prompts = materialised(batch.withColumn("row", F.monotonically_increasing_id()), f"{store.root}/{work}")
            outputs = checked(generated(prompts.select(F.col("row").alias("prompt_idx"), "prompt"), **options), validate=validate)
            outputs = materialised(outputs, f"{store.root}/{work}").withColumnRenamed("prompt_idx", "row").join(prompts, "row")
            place = F.concat(session_folder(F.col("session")), F.lit("/"), prompt_directory(stamp, F.col("prompt_idx")))
            write_files(generation_files(with_midi(outputs).withColumn("directory", place)), root, mark)
        finally:
            store.delete(work)

    return handle
