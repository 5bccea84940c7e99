"""Rows written as named files, all of them or none, on any store that Spark writes to.

`write_files` takes rows of (path STRING relative to the root, content BINARY). They are written in two phases. First, tasks write
into a staging folder under the root with Spark's own writers, so failed and repeated attempts are Spark's to clean up. Then
the driver renames each file to its place; if that fails, what was renamed is taken back and what it replaced is put back. In
the end the staging folder goes, whatever happened. No file's content comes to the driver.

Bytes go through the text writer, in a folder for each path. That writer ends a record with a separator of one byte, which
must not be empty; so a file's last byte is taken off and given as the separator, and files with equal last bytes are one write.

Paths that leave the root, null paths or contents, and paths that occur twice are errors, found before anything is renamed."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """A folder on the store that its URI names, by way of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        # The local file system keeps checksum files beside others; those of staged files stay behind and go with them.
        if self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.ChecksumFileSystem").isInstance(self.fs):
            self.fs = self.fs.getRawFileSystem()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename(self, name: str, to: str) -> None:
        target = self.path(to)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self.path(name), target):
            raise OSError(f"{name} can't be renamed to {to} in {self.root}")

    def names(self, folder: str) -> Iterator[str]:
        """Names of what is in a folder, one after another."""
        found = self.fs.listStatusIterator(self.path(folder))
        while found.hasNext():
            yield found.next().getPath().getName()

    def below(self, folder: str) -> Iterator[str]:
        """Paths of all files in a folder and its folders, relative to it."""
        base = self.path(folder).toUri().getPath()
        found = self.fs.listFiles(self.path(folder), True)
        while found.hasNext():
            yield found.next().getPath().toUri().getPath()[len(base) + 1 :]

    def create(self, name: str, content: bytes = b"") -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def joined(self, folders: list[str], name: str, between: list[str]) -> None:
        """One file of the part files of folders, in order, streamed through a small buffer."""
        out = self.fs.create(self.path(name), True)
        try:
            for folder, text in zip([None, *folders], between, strict=True):
                for part in sorted(n for n in self.names(folder) if n.startswith("part-")) if folder else ():
                    into = self.fs.open(self.path(f"{folder}/{part}"))
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, self.conf, False)
                    finally:
                        into.close()
                out.write(bytearray(text.encode()))
        finally:
            out.close()


def _whole(rows: DataFrame) -> DataFrame:
    """path, last (the last byte, -1 of an empty file), body (the bytes before it); errors where the rows aren't files."""
    path = F.col("path")
    outside = path.rlike(r"^$|^/|(^|/)\.{1,2}(/|$)|^_|/$|//|[\x00-\x1F]") | path.contains("\\")
    wrong = F.when(path.isNull(), F.lit("a file has no path")).when(outside, F.concat(path, F.lit(" is outside the folder")))
    wrong = wrong.when(F.col("content").isNull(), F.concat(path, F.lit(" has no content")))
    one = rows.select(F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(path).alias("path"), "content")
    one = one.groupBy("path").agg(F.count("*").alias("n"), F.first("content").alias("content"))
    size = F.length("content")
    last = F.when(size > 0, F.conv(F.hex(F.substring("content", -1, 1)), 16, 10).cast("int")).otherwise(-1)
    named = F.when(F.col("n") > 1, F.raise_error(F.concat("path", F.lit(" occurs more than once")))).otherwise(F.col("path"))
    return one.select(named.alias("path"), F.substring("content", F.lit(1), F.greatest(size - 1, F.lit(0))).alias("body"), last.alias("last"))


@contextlib.contextmanager
def staging(spark: SparkSession, root: str) -> Iterator[tuple[Store, str]]:
    """The store at the root and the name of a folder in it, which goes at the end."""
    store, name = Store(spark, root), f"_staging-{uuid.uuid4().hex}"
    store.fs.mkdirs(store.path(name))
    try:
        yield store, name
    finally:
        store.delete(name)


def write_files(rows: DataFrame, root: str, mark: str | None = None) -> None:
    """Writes each row as a file below the root; files that are there are replaced. `mark` names an empty file that appears
    last of all. Rows are read once."""
    spark = rows.sparkSession
    with staging(spark, root) as (store, work):
        _whole(rows).write.partitionBy("last").parquet(f"{store.root}/{work}/rows")
        kinds = sorted(int(n.partition("=")[2]) for n in store.names(f"{work}/rows") if n.startswith("last="))
        staged = spark.read.schema("path string, body binary, last int").parquet(f"{store.root}/{work}/rows")
        for k in kinds:
            own = staged.where(F.col("last") == k).select(F.col("body").cast("string").alias("value"), "path")
            if k >= 0:
                own.write.partitionBy("path").option("encoding", "ISO-8859-1").option("lineSep", chr(k)).text(f"{store.root}/{work}/{k}")
            else:
                for row in own.toLocalIterator():
                    store.create(f"{work}/{k}/path={row['path']}/part-0")
        _commit(store, work, kinds)
        if mark:
            store.create(mark)


def _staged(store: Store, work: str, kinds: list[int]) -> Iterator[tuple[str, str]]:
    """(staged name, path) of the files of all kinds."""
    for k in kinds:
        if k < 0:
            for own in store.below(f"{work}/{k}"):
                yield f"{work}/{k}/{own}", own[len("path=") : -len("/part-0")]
            continue
        for folder in store.names(f"{work}/{k}"):
            if folder.startswith("path="):
                parts = [n for n in store.names(f"{work}/{k}/{folder}") if n.startswith("part-")]
                if len(parts) != 1:
                    raise OSError(f"{folder} has {len(parts)} files")
                yield f"{work}/{k}/{folder}/{parts[0]}", unquote(folder[len("path=") :])


def _commit(store: Store, work: str, kinds: list[int]) -> None:
    """Renames all staged files to their places, or none."""
    done = 0
    try:
        for name, path in _staged(store, work, kinds):
            if store.exists(path):
                store.rename(path, f"{work}/old/{path}")
            store.rename(name, path)
            done += 1
    except BaseException:
        _undo(store, work, done)
        raise


def _undo(store: Store, work: str, done: int) -> None:
    """Takes back renamed files, which are those that staging hasn't got any more, and puts back what they replaced."""
    escape = store.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    rows = SparkSession.active().read.schema("path string, last int").parquet(f"{store.root}/{work}/rows")
    for row in rows.toLocalIterator() if done else ():
        folder = f"{work}/{row['last']}/path={row['path'] if row['last'] < 0 else escape(row['path'])}"
        if not any(n.startswith("part-") for n in store.names(folder)) and store.exists(row["path"]):
            store.delete(row["path"])
    if store.exists(f"{work}/old"):
        for own in list(store.below(f"{work}/old")):
            store.rename(f"{work}/old/{own}", own)


def write_joined(tables: list[DataFrame], root: str, path: str, between: list[str]) -> None:
    """One text file of tables of lines (value STRING), each in its order, with the strings of `between` before, between and
    behind them. Parts are written by tasks and joined by a stream, so neither the driver nor a task holds them all."""
    with staging(tables[0].sparkSession, root) as (store, work):
        for k, lines in enumerate(tables):
            lines.write.text(f"{store.root}/{work}/{k}")
        store.joined([f"{work}/{k}" for k in range(len(tables))], f"{work}/whole", between)
        if store.exists(path):
            store.delete(path)
        store.rename(f"{work}/whole", path)


def json_items(items: DataFrame, value: Column, *keys: str) -> tuple[DataFrame, bool]:
    """(value: the elements of a JSON array, one a line, in order of the keys, which must differ; whether there are any)."""
    first = items.orderBy(*keys).select(*keys).first()
    text = F.to_json(F.array(value))
    own = F.expr("substring(_t, 2, length(_t) - 2)")
    begins = F.lit(True)
    for k in keys if first else ():
        begins = begins & F.col(k).eqNullSafe(F.lit(first[k]))
    rows = items.select(*keys, text.alias("_t")).orderBy(*keys)
    return rows.select(F.concat(F.when(begins, "    ").otherwise("  , "), own).alias("value")), first is not None


def generation_files(outputs: DataFrame) -> DataFrame:
    """path, content: prompt.txt once for each directory, and each good output's tokens, MIDI and, if there is any, audio.
    Outputs have directory, prompt, output_idx, tokens, midi, ok, and may have audio and audio_kind; those that aren't ok
    leave nothing."""
    good = outputs.where("ok")
    text = good.groupBy("directory").agg(F.min("prompt").alias("prompt")).select(F.concat("directory", F.lit("/prompt.txt")).alias("path"), F.encode("prompt", "UTF-8").alias("content"))
    listed = F.concat(F.array_join(F.col("tokens").cast("array<string>"), "\n"), F.lit("\n"))
    tokens = good.select(F.format_string("%s/gen_%d_tokens.txt", "directory", "output_idx"), F.encode(listed, "UTF-8"))
    midi = good.select(F.format_string("%s/gen_%d.mid", "directory", "output_idx"), "midi")
    files = text.union(tokens).union(midi)
    if "audio" in outputs.columns:
        files = files.union(good.where("audio is not null").select(F.format_string("%s/gen_%d.%s", "directory", "output_idx", "audio_kind"), "audio"))
    return files
