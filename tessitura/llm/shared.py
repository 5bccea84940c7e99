"""What the corpus operators share: the folder all executors see, written tables, and Arrow text blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in blocks of about this many bytes, so temporary arrays stay small.
BLOCK_BYTES = 1 << 19
#: What `meetings` returns.
MEETINGS = "key long, class long, n int, low long, low_n int"
#: Of each application whose session names no folder, the temporary one.
_LOCAL: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors must see. Where it is unset, a local session's driver
    and executors are one machine and a temporary folder will do; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # A running session doesn't take this setting any more, so its folder is remembered here.
        own = spark.sparkContext.applicationId
        if own not in _LOCAL:
            _LOCAL[own] = tempfile.mkdtemp(prefix="tessitura-")
        folder = _LOCAL[own]
    return f"{folder.rstrip('/')}/tessitura/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: lineage ends here and survives lost executors. Nothing
    reads the write's shuffle files afterwards, so Spark is told to remove them when it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.rpartition(":")[2] in folder:
            path.getFileSystem(conf).delete(path, True)


def held(df: DataFrame) -> DataFrame:
    """`df` worked out once and held on the executors' disks, until `unpersist`; what a lost executor held is worked out again.
    For tables that are read more than once within an operator: unlike `written` it makes no files of its own, but its lineage
    goes on, so rows must not depend on how often they are worked out."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so further columns of any name can't clash with those an operator adds."""
    return df.select(*[df[f"`{n}`"] for n in names])


def apart(df: DataFrame, *stay: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with all columns but `stay` renamed by position, so none clashes with those an operator adds; and what gives the
    columns their names back, leaving others out."""
    names = df.columns
    safe = [n if n in stay else f"_x{k}" for k, n in enumerate(names)]
    out = df.select(*[F.col("`" + n.replace("`", "``") + "`").alias(m) for n, m in zip(names, safe, strict=True)])
    return out, lambda made: made.select(*[F.col(m).alias(n) for n, m in zip(names, safe, strict=True)])


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (UTF-8) or binary column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts; a longer text comes alone."""
    data, at = raw_text(column)
    rows, lo = len(at) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def packed(schema: pa.Schema, **values) -> pa.RecordBatch:
    """A record batch with the columns of `schema` from arrays or lists."""
    return pa.RecordBatch.from_arrays([v if isinstance(v := values[f.name], pa.Array) and v.type == f.type else pa.array(v, f.type, from_pandas=False) for f in schema], schema=schema)


def digits(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of `counts`, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def groups(batches: Iterator[pa.RecordBatch], key: str = "g") -> Iterator[pa.Table]:
    """Runs of rows with an equal key, over batches of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, class, n, low, low_n (the key's smallest class) of keys with two classes at least, from rows sorted by key and
    class. Only a run's first row is held from batch to batch, however long the run."""
    last = None  # key, class, n of the row before; the run's low and low_n; whether its first row is out
    for batch in batches:
        key, name, size = (batch.column(k).to_numpy() for k in range(3))
        if not len(key):
            continue
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        new[0] = last is None or (key[0], name[0]) != last[:2]
        key, name, size = key[new], name[new], size[new]
        if not len(key):
            continue
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        joined = last is not None and key[0] == last[0]
        begins[0] = not joined
        head = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        low, low_n = name[np.maximum(head, 0)], size[np.maximum(head, 0)]
        if joined:
            old = head < 0
            low, low_n = np.where(old, last[3], low), np.where(old, last[4], low_n)
        follows = ~begins
        several = follows.copy()
        several[:-1] |= follows[1:]
        out = [key[several], name[several], size[several], low[several], low_n[several]]
        if joined and not last[5]:  # the run's first row waited for this
            out = [np.concatenate([[x], y]) for x, y in zip((last[0], last[3], last[4], last[3], last[4]), out, strict=True)]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(out, (np.int64, np.int64, np.int32, np.int64, np.int32), strict=True)], ["key", "class", "n", "low", "low_n"])
        last = (key[-1], name[-1], size[-1], low[-1], low_n[-1], bool(follows[-1]))
