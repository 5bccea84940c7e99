"""Best-fit packing of documents into sequences, by vectors of residual capacities.

A bin has three capacities: tokens, documents and attention cost (a piece of n tokens costs n * n). Pieces of equal
length are equal vectors, and bins with equal residuals are equal too, so the packing is planned over counts: longest
pieces first, each into the class of bins that scores best among those with room in every capacity. The plan's size
depends on the sequence length alone, never on the number of documents. Pieces then take their places by their rank
among pieces of their length; ranks are counted in salted groups, as many of a length as the root of its number of pieces, so
neither a group nor the number of groups of a length is large.

Defined results: null and empty texts have no ids besides the end mark; repeated rows are packed each; rows with a null
doc_id too; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.shared import columns, text_blocks, written
from tessitura.llm.tokens import VOCABULARY, encoded_block

#: Bytes of text tokenized together.
TEXT_BLOCK = 1 << 20
PIECES = "doc_id {0}, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Whole texts as ids, then `end_id`; longer ones cut from the end, so only a first piece may be shorter."""
    source = columns(documents, "doc_id", "text")
    schema = PIECES.format(dict(source.dtypes)["doc_id"]) + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in text_blocks(batch.column(1), TEXT_BLOCK):
                ids, to = encoded_block(vocabulary, data, at)
                ids = np.insert(ids.astype("<u4"), to[1:], end_id)
                to = to + np.arange(len(to))
                size = np.diff(to)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = size - (n - 1) * capacity
                start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[row], capacity)
                raw = memoryview(ids).cast("B")
                begin = to[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(row + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, to[-1]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return source.mapInArrow(work, schema)


def plan(counts: dict[int, int], capacity: int = 2048, max_documents: int | None = None, max_cost: int | None = None, score: str = "dot", weights: tuple[float, float, float] = (1.0, 0.05, 0.2)) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): where pieces of each length go.

    `score`: "dot" takes the bins with the smallest weighted dot-product of the piece and what would remain, "norm" those with
    the smallest weighted norm of what would remain; both as shares of the capacities. A limit that isn't given can't bind.
    A piece that breaks a capacity even in an empty bin raises ValueError.
    """
    documents, cost = max_documents or capacity, max_cost or capacity * capacity
    full = np.array([capacity, documents, cost], float)
    w = np.array(weights)
    out: list[tuple[int, int, int, int, int]] = []
    residual = np.zeros((0, 3), np.int64)  # of classes of bins
    bins: list[list[tuple[int, int]]] = []  # sequences of each class, as ranges
    used = 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities of an empty sequence")
        left, rank = counts[length], 0
        while left:
            room = np.flatnonzero((residual >= need).all(axis=1)) if len(residual) else []
            if not len(room):
                fit = min(capacity // length, documents, cost // (length * length))
                new, each = (left // fit, fit) if left >= fit else (1, left)
                for k in range(each):
                    out.append((length, rank, rank + new, used, k * length))
                    rank += new
                left -= new * each
                residual, bins = _add(residual, bins, np.array([capacity, documents, cost]) - each * need, [(used, used + new)])
                used += new
                continue
            after = (residual[room] - need) / full
            if score == "norm":
                best = room[int(np.argmin((w * after * after).sum(axis=1)))]
            else:
                best = room[int(np.argmin(after @ (w * need / full)))]
            # All of a class take as many of these pieces as fit, or fewer bins do when pieces run out.
            offset = capacity - int(residual[best, 0])
            lo, hi = bins[best].pop()
            take = min(hi - lo, left)
            out.append((length, rank, rank + take, lo, offset))
            rank, left = rank + take, left - take
            if lo + take < hi:
                bins[best].append((lo + take, hi))
            rest = residual[best] - need
            if not bins[best]:
                residual = np.delete(residual, best, axis=0)
                del bins[best]
            residual, bins = _add(residual, bins, rest, [(lo, lo + take)])
    return out


def _add(residual: np.ndarray, bins: list, rest: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, list]:
    """With bins of a residual, in the class that has it already if one has."""
    if rest[0] <= 0 or rest[1] <= 0:
        return residual, bins
    same = np.flatnonzero((residual == rest).all(axis=1)) if len(residual) else []
    if len(same):
        bins[same[0]].extend(ranges)
        return residual, bins
    return np.vstack([residual, rest[None, :]]), [*bins, ranges]


def placed(cut: DataFrame, capacity: int = 2048, **limits) -> DataFrame:
    """`cut` (see `pieces`, a table that can be read several times) with sequence_id and offset."""
    spark = cut.sparkSession
    # At most `capacity` rows, one for each length.
    total = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    sizes = spark.createDataFrame([(length, 1 + isqrt(n)) for length, n in total.items()], "length long, _salts long")
    own = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).cast("int").alias("_salt")
    salted = cut.join(F.broadcast(sizes), "length").select(*cut.columns, own)
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    rows = plan(total, capacity, **limits)
    by: dict[int, list] = {}
    for row in sorted(rows):
        by.setdefault(row[0], []).append(row)
    tables = {k: np.array(v, np.int64) for k, v in by.items()}
    held = spark.sparkContext.broadcast(tables)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "_salt", before.alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_within", within).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_within"))
    names = cut.columns
    source = ranked.select(*names, "_rank")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for value, own in zip(values.tolist(), np.split(order, first[1:]), strict=True):
                table = held.value[value]
                k = np.searchsorted(table[:, 1], rank[own], "right") - 1
                sequence[own] = table[k, 3] + rank[own] - table[k, 1]
                offset[own] = table[k, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return source.mapInArrow(work, ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long")


def packed_documents(documents: DataFrame, capacity: int = 2048, with_ids: bool = False, vocabulary: str = VOCABULARY, **limits) -> DataFrame:
    return placed(written(pieces(documents, capacity, vocabulary=vocabulary, with_ids=with_ids), "pieces"), capacity, **limits)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
