"""Exact removal of repeated byte strings, by suffix arrays over the places where strings may repeat.

Each window of `length` bytes is anchored at the smallest hash of its 32-byte grams, which depends on its content alone,
so equal windows have equal anchors at equal offsets. Anchors of all texts meet by hash. Where whole contexts (all
windows that may use the anchor) are equal, they repeat throughout. Of the other contexts, one copy each, those that
agree with another on one side go into suffix arrays, block by block of whole anchor groups: two-stage sorting sorts only
suffixes smaller than their successors, induces the rest by scanning the buckets, and adjacent common prefixes of at least
`length` bytes tell the windows that repeat. A group of too many different contexts for one block is taken apart into
single windows, counted by hash with partial sums, so its size is not bounded by memory.

Defined results: null and empty texts have no bytes; repeated rows repeat each other; rows with null ids are texts as
well; texts shorter than `length` are never cut; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.shared import columns, digits, discard, raw_text, text_blocks, written
from tessitura.llm.words import mix, prefix_sums, span_hashes, string_hashes

LENGTH, GRAM = 200, 32
#: Different contexts of an anchor that go into one suffix array; more are taken apart.
GROUP = 4096
#: Bytes in a suffix array, about.
ARRAY_BYTES = 1 << 20


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least. Those smaller than their successor are sorted directly;
    the others are put in place by one scan of the buckets in order, since each follows from its successor's place.
    With `wanted` (by suffix), only those and the successors that put them in place."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller[i]: suffix i is smaller than suffix i + 1. Equal neighbours take the type of the next difference.
    smaller = np.zeros(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    differs = np.append(text[:-1] != text[1:], True)
    ahead = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = smaller[ahead]
    wanted = np.ones(n, bool) if wanted is None else wanted | _following(wanted, smaller)
    direct = np.flatnonzero(smaller & wanted)
    raw = text.tobytes()
    keys = [raw[i : i + depth] for i in direct.tolist()]
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    del keys
    direct = direct[order]
    heads = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[-1]:
        waiting[text[-1]].append(np.array([n - 1], np.int64))
    induced = wanted & ~smaller
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        bucket = []
        while len(level):
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & induced[before]]
        bucket.append(direct[heads[c] : heads[c + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[(text[before] > c) & induced[before]]
        if not len(before):
            continue
        first = text[before]
        by = np.argsort(first, kind="stable")
        values, cuts = np.unique(first[by], return_index=True)
        for value, own in zip(values.tolist(), np.split(before[by], cuts[1:]), strict=True):
            waiting[value].append(own)
    return np.concatenate(out)


def _following(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The successors that induced suffixes among the wanted ones follow from: up to the next direct one after each."""
    here = np.arange(len(wanted))
    last_wanted = np.maximum.accumulate(np.where(wanted, here, -1))
    last_direct = np.maximum.accumulate(np.where(smaller, here, -1))
    # Reached if no direct suffix lies from the last wanted one up to the one before here.
    before = np.concatenate([[-1], last_direct[:-1]])
    return (last_wanted >= 0) & (before < last_wanted)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of `order` shares with the one before it, up to `most`; 0 for the first.

    Where a suffix and the one before it both move on by one byte in the text, and the bytes left behind are equal, the next
    pair shares one byte less. So only the last pair of each such chain is compared; the others follow from it."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    before = np.full(len(text) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    own = np.flatnonzero(before[:-1] >= 0)
    other = before[own]
    goes_on = (before[own + 1] == other + 1) & (text[own] == text[other])
    tail = np.flatnonzero(~goes_on)
    a, b = own[tail], other[tail]
    eight = np.ndarray(len(text), ">u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    shared = np.zeros(len(tail), np.int64)
    rows = np.arange(len(tail))
    for at in range(0, most, 8):
        x, y = a[rows] + at, b[rows] + at
        room = np.minimum(len(text) - np.maximum(x, y), 8)
        live = room > 0
        rows, x, y, room = rows[live], x[live], y[live], room[live]
        if not len(rows):
            break
        differ = (eight[x] ^ eight[y]).astype(np.uint64)
        same = np.zeros(len(rows), np.int64)
        for k in range(8):
            same += differ < np.uint64(1) << np.uint64(56 - 8 * k)
        same = np.minimum(same, room)
        shared[rows] += same
        rows = rows[same == 8]
    last = tail[np.searchsorted(tail, np.arange(len(own)))]
    value = np.zeros(len(text), np.int64)
    value[own] = np.minimum(shared[np.searchsorted(tail, last)] + own[last] - own, most)
    out = value[order]
    out[0] = 0
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, keys: np.ndarray, length: int) -> np.ndarray:
    """True for each start whose string of `length` bytes begins at another start with an equal key. Starts ascend."""
    valid = np.full(len(text), -1, np.int64)
    valid[starts] = np.arange(len(starts))
    order = suffix_array(text, length, valid >= 0)
    order = order[valid[order] >= 0]
    run = np.cumsum(common_prefixes(text, order, length) < length)
    which = valid[order]
    several = np.bincount(run, minlength=run[-1] + 1 if len(run) else 1)[run] > 1
    which, run = which[several], run[several]
    found = np.zeros(len(starts), bool)
    by = np.lexsort((keys[which], run))
    which, run = which[by], run[by]
    same = (run[1:] == run[:-1]) & (keys[which[1:]] == keys[which[:-1]])
    found[which[1:][same]] = True
    found[which[:-1][same]] = True
    return found


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor positions, number of the text of each)."""
    sums = prefix_sums(data)
    width = length - gram + 1  # grams in a window
    n = len(data) - gram + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = np.arange(n)
    mask = np.uint64((1 << int(len(data)).bit_length()) - 1)
    value = (span_hashes(sums, here, here + gram) & ~mask) | here.astype(np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[:n] = value
    table = padded.reshape(rows, width)
    up = np.minimum.accumulate(table, axis=1).ravel()
    down = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(_inside(at, length, n - width + 1))
    least = np.minimum(down[starts], up[starts + width - 1]) & mask
    place = np.unique(least.astype(np.int64))
    return place, np.searchsorted(at, place, "right") - 1


def _inside(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each of n positions, whether a window that starts there ends in the same text."""
    change = np.zeros(at[-1] + 2, np.int64)
    size = np.diff(at)
    own = size >= length
    np.add.at(change, at[:-1][own], 1)
    np.add.at(change, at[1:][own] - length + 1, -1)
    return np.cumsum(change)[:n] > 0


def _anchor_rows(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """_k, mark, a (anchor), c (context), sides (left and right parts, 32 bits each), pos, m (occurrences) of anchors, one
    row for equal contexts of a block. The other occurrences are known to repeat: their joined spans are rows of m = 0,
    with the span in pos and c, and dealt anywhere."""
    source = _keyed(documents)
    reach = length - gram

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in text_blocks(batch.column(2)):
                place, text = anchors(data, at, length, gram)
                if not len(place):
                    continue
                begin, end = at[text], at[text + 1]
                left, right = np.maximum(place - reach, begin), np.minimum(place + length, end)
                near, far = np.maximum(place - reach // 2, begin), np.minimum(place + length - reach // 2, end)
                a = string_hashes(data, place, place + gram)
                c = mix(string_hashes(data, left, right) + (place - left).astype(np.uint64))
                half = np.uint64(32)
                sides = ((string_hashes(data, near, place + gram) + (place - near).astype(np.uint64)) >> half << half) | ((string_hashes(data, place, far) + (far - place).astype(np.uint64)) >> half)
                _, first, count = np.unique(mix(a + mix(c)), return_index=True, return_counts=True)
                other = np.ones(len(place), bool)
                other[first] = False
                o, f = np.flatnonzero(other), text[other]
                new = np.ones(len(o), bool)
                new[1:] = (f[1:] != f[:-1]) | (left[o[1:]] > right[o[:-1]])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(o)) - 1 if len(o) else head
                known = o[head]
                end_of = (right[o[tail]] - begin[known]).astype(np.uint64)
                take = np.concatenate([first, known])
                rows = pa.array(text[take] + lo)
                a = np.concatenate([a[first], mix(a[known] + (left[known] + 1).astype(np.uint64))])
                c = np.concatenate([c[first], end_of])
                pos = np.concatenate([place[first] - begin[first], left[known] - begin[known]])
                m = np.concatenate([count, np.zeros(len(known), np.int64)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x.view(np.int64)) for x in (a, c, sides[take])), pa.array(pos.astype(np.int32)), pa.array(m.astype(np.int32))], ["_k", "mark", "a", "c", "sides", "pos", "m"])

    return source.mapInArrow(work, f"_k {dict(source.dtypes)['_k']}, mark long, a long, c long, sides long, pos int, m int")


def _keyed(documents: DataFrame) -> DataFrame:
    """_k, mark, text: a row's key, the same for repeated rows only. Null ids count as the text's hash."""
    source = columns(documents, "doc_id", "text")
    return source.select(*_key_columns(source), "text")


def _contexts(documents: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """wanted (_k, mark, a, pos) with `left` (first byte in the text) and `context`."""
    source = _keyed(documents).join(wanted.groupBy("_k", "mark").agg(F.collect_set(F.struct("a", "pos")).alias("want")), ["_k", "mark"])
    kind = dict(source.dtypes)["_k"]
    reach = length - gram

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_k", "mark", "a", "pos", "left", "context"]
        for batch in batches:
            want, to = batch.column(3), batch.column(3).offsets.to_numpy()
            a, pos = (want.values.field(k) for k in ("a", "pos"))
            for lo, hi, data, at in text_blocks(batch.column(2)):
                own = np.arange(to[lo], to[hi])
                of = np.repeat(np.arange(hi - lo), np.diff(to[lo : hi + 1]))
                place = pos.to_numpy()[own]
                left = np.maximum(place - reach, 0)
                raw, base = data.tobytes(), at[of]
                cut = [raw[x:y] for x, y in zip((base + left).tolist(), np.minimum(base + place + length, at[of + 1]).tolist(), strict=True)]
                rows, mine = pa.array(of + lo), pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), a.take(mine), pos.take(mine), pa.array(left.astype(np.int32)), pa.array(cut, pa.binary())], names)

    return source.select("_k", "mark", "text", "want").mapInArrow(work, f"_k {kind}, mark long, a long, pos int, left int, context binary").dropDuplicates(["_k", "mark", "a", "pos"])


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans covered by strings of `length` bytes from the given ascending starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.concatenate([gap, [len(starts) - 1]])] + length).tolist(), strict=True))


def _by_arrays(contexts: DataFrame, length: int, gram: int, array_bytes: int) -> DataFrame:
    """Spans (_k, mark, start, end) of repeated windows, by suffix arrays over blocks of whole anchor groups."""
    kind = dict(contexts.dtypes)["_k"]
    reach = length - gram
    names = ["_k", "mark", "start", "end"]

    def solved(rows: list[dict]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r["context"] for r in rows), np.uint8)
        size = np.array([len(r["context"]) for r in rows])
        begin = np.cumsum(size) - size
        left = np.array([r["left"] for r in rows])
        offset = np.array([r["pos"] for r in rows]) - left  # of the anchor in its context
        windows = np.maximum(np.minimum(size - length, offset) + 1, 0)
        of = np.repeat(np.arange(len(rows)), windows)
        starts = begin[of] + digits(windows)
        group = np.unique(np.array([r["a"] for r in rows]), return_inverse=True)[1]
        keys = group[of] * (reach + 1) + offset[of] - digits(windows)
        hit = repeated_starts(text, starts, keys, length)
        of, starts = of[hit], starts[hit]
        out = []
        for i, own in zip(*np.unique(of, return_index=True), strict=True):
            mine = starts[own : own + int(np.searchsorted(of[own:], i, "right"))] - begin[i] + left[i]
            out += [(rows[i]["_k"], rows[i]["mark"], a, b) for a, b in _runs(mine, length)]
        return pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)}, schema=pa.schema([("_k", pa.int64() if kind == "bigint" else pa.string()), ("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                if held >= array_bytes and row["a"] != rows[-1]["a"]:
                    yield solved(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row["context"])
        if rows:
            yield solved(rows)

    return contexts.repartition("a").sortWithinPartitions("a").mapInArrow(work, f"_k {kind}, mark long, start long, end long")


def _by_windows(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same spans for anchors of too many contexts: each window counted by its hash."""
    kind = dict(contexts.dtypes)["_k"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                data, at = raw_text(part.column("context"))
                left, pos = part.column("left").to_numpy(), part.column("pos").to_numpy()
                n = np.maximum(np.minimum(np.diff(at) - length, pos - left) + 1, 0)
                of, here = np.repeat(np.arange(len(n)), n), digits(n)
                start = at[of] + here
                w = mix(string_hashes(data, start, start + length) + (pos[of] - left[of] - here).astype(np.uint64))
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(rows) for k in ("_k", "mark", "a")), pa.array(w.view(np.int64)), pa.array(here + left[of])], ["_k", "mark", "a", "w", "start"])

    rows = contexts.mapInArrow(work, f"_k {kind}, mark long, a long, w long, start long")
    often = rows.groupBy("a", "w").agg(F.count("*").alias("n")).where("n > 1").select("a", "w")
    return rows.join(often, ["a", "w"], "left_semi").select("_k", "mark", "start", (F.col("start") + length).alias("end"))


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """_k, mark, spans (array of start, end; they may overlap and pass the text's end) of texts with repeated strings."""
    reach = length - gram
    rows = _anchor_rows(documents, length, gram).repartition("a")
    whole = Window.partitionBy("a")
    equal = Window.partitionBy("a", "c")
    rows = rows.withColumn("n", F.sum("m").over(equal)).withColumn("nth", F.row_number().over(equal.orderBy("_k", "mark", "pos"))).withColumn("total", F.sum("m").over(whole))
    rows = rows.withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(whole)).where("total > 1 or m = 0")
    rows = written(rows, "anchors")
    # Only what agrees with a different context on a side can repeat a window of it.
    some = rows.where("kinds > 1 and m > 0")
    left, right = F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND(0xFFFFFFFF)
    some = some.withColumn("l", left).withColumn("r", right).where("nth = 1")
    some = some.withColumn("nl", F.count("*").over(Window.partitionBy("a", "l"))).withColumn("nr", F.count("*").over(Window.partitionBy("a", "r"))).where("nl > 1 or nr > 1")
    some = some.withColumn("kinds", F.count("*").over(whole))
    wanted = written(some.select("_k", "mark", "a", "pos", "kinds"), "wanted")
    contexts = written(_contexts(documents, wanted.select("_k", "mark", "a", "pos"), length, gram), "contexts") if wanted.take(1) else None
    known = F.col("m") == 0
    start = F.when(known, F.col("pos")).otherwise(F.greatest(F.col("pos") - reach, F.lit(0))).cast("long")
    end = F.when(known, F.col("c")).otherwise((F.col("pos") + length).cast("long"))
    spans = rows.where("n > 1 or m = 0").select("_k", "mark", start.alias("start"), end.alias("end"))
    if contexts is not None:
        hot = written(wanted.where(F.col("kinds") > group).select("a").distinct(), "hot")
        spans = spans.union(_by_arrays(contexts.join(hot, "a", "left_anti"), length, gram, array_bytes).select("_k", "mark", "start", "end"))
        if hot.take(1):
            spans = spans.union(_by_windows(contexts.join(hot, "a", "left_semi"), length, gram))
    return spans.groupBy("_k", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(documents: DataFrame, length: int = LENGTH, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document; with_text: also `kept`, the remaining bytes."""
    spans = written(repeated_spans(documents, length, **options), "spans")
    names = columns(documents, "doc_id", "text")
    keyed = names.select("doc_id", "text", *_key_columns(names)).join(spans, ["_k", "mark"], "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, spans = batch.column(1).cast(pa.binary()), batch.column(2)
            size, gone, runs, digest, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                text = data[i].as_py() or b""
                removed = 0
                count = 0
                if spans[i].is_valid:
                    parts, last = [], 0
                    own = spans[i].values
                    pairs = sorted(zip(own.field("start").to_pylist(), own.field("end").to_pylist(), strict=True))
                    lo, hi = pairs[0]
                    for a, b in [*pairs[1:], (1 << 62, 1 << 62)]:
                        if a <= hi:
                            hi = max(hi, b)
                            continue
                        hi = min(hi, len(text))
                        parts.append(text[last:lo])
                        removed, count, last = removed + hi - lo, count + 1, hi
                        lo, hi = a, b
                    left = b"".join([*parts, text[last:]])
                else:
                    left = text
                size.append(len(text))
                gone.append(removed)
                runs.append(count)
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left)
            out = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.binary())] if with_text else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return keyed.mapInArrow(work, f"doc_id {dict(names.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _key_columns(source: DataFrame) -> list:
    mark = F.xxhash64("text")
    own = F.coalesce(F.col("doc_id"), mark) if dict(source.dtypes)["doc_id"] == "bigint" else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return [own.alias("_k"), mark.alias("mark")]


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
rep AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN rep USING (m)),
run AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, r, min(i) AS s, max(i) + 200 AS e FROM run GROUP BY ALL),
cut AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM span),
part AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS k
         FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN part USING (doc_id)
"""
