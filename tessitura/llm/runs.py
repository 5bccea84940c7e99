"""Runs of periodic words, by Lyndon roots (the approach of Ellert and Fischer), and texts without their repetitions.

A run is a stretch with smallest period q of at least 2 * q words that no neighbouring word extends. Under one of two opposite
orders of the words, each run holds a Lyndon word of length q that ends where the next smaller suffix begins. So:

1. Words get their ranks by sorting; from here on only ranks are compared.
2. `lyndon` finds each place's next smaller suffix from left to right, on a chain of previous smaller ones, and keeps how far
   each compared pair agrees. The stretch that was matched furthest to the right is a copy of one further left, so what was
   found for a pair there holds for its image up to the copy's end, and only words beyond that are compared. Agreement with
   one place of the chain and that between two places of it settle the next, unless both are equal. Tests hold this to
   three comparisons a word, for all short sequences of two words and for families of structured long ones.
3. A root's agreement with the suffix behind it is its extension to the right; one to the left is matched once for each run.

No suffix structure is built, and nothing is decided by hashes.

A word in a run, behind the first q, stands at most q behind an equal one, and q is at most the number of such words in the run.
So stretches of words of which each has an equal one as near before it as the stretch is long hold all runs' later parts; these
and as many words before them are looked at, others are not. In ordinary text that leaves little.

Defined results: null and empty texts have no words, no runs and an empty text; repeated rows are documents of their own; of runs that
overlap each drops its own words; a text may be one run of any length; further columns are ignored; empty tables give no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.shared import columns, text_blocks
from tessitura.llm.words import NOT_SPACE, word_spans

LEAST = 12


def lyndon(t: list[int]) -> tuple[list[int], list[int], int]:
    """Of each place, where the next smaller suffix begins (the length where there is none) and how many words both agree in;
    and the number of words compared. A suffix is smaller than those it begins."""
    n, compared = len(t), 0
    following, agree = [n] * n, [0] * n
    before, held = [-1] * n, [0] * n  # the previous smaller suffix, and how far it agrees
    begin = reach = shift = 0  # t[begin:reach] is a copy of what is `shift` places before it
    for i in range(1, n):
        j, k = i - 1, 0
        while j >= 0:
            if begin <= j and reach - i > k:
                x, y = j - shift, i - shift
                known = agree[x] if following[x] == y else held[y] if before[y] == x else 0
                k = max(k, min(known, reach - i))
            start = k
            while i + k < n and t[j + k] == t[i + k]:
                k += 1
            compared += k - start + (i + k < n)
            if i + k > reach:
                begin, reach, shift = i, i + k, i - j
            if i + k < n and t[j + k] < t[i + k]:
                before[i], held[i] = j, k
                break
            following[j], agree[j] = i, k
            j, own = before[j], held[j]
            while j >= 0 and own > k:  # this one agrees longer with the one behind it than i does
                following[j], agree[j] = i, k
                j, own = before[j], held[j]
            if j >= 0 and own < k:
                before[i], held[i] = j, own
                break
    return following, agree, compared


def runs_of(t: list[int], least: int = LEAST) -> tuple[list[tuple[int, int, int]], int]:
    """(start, length, period) of all runs of `least` words or more, ascending; and the number of words compared."""
    found, compared = set(), 0
    for order in (t, [-x for x in t]):
        following, agree, n = lyndon(order)
        compared += n
        ends: dict[int, int] = {}  # of the last run of each period
        for j, (i, right) in enumerate(zip(following, agree, strict=True)):
            p = i - j
            if not right or ends.get(p, 0) >= i:  # no run, or a root of one that is known
                continue
            need, left = p - right, 0
            if need > 0 and (need > j or t[j - need] != t[i - need]):
                continue
            while left < j and t[j - left - 1] == t[i - left - 1]:
                left += 1
            compared += left + 1
            if left >= need:
                ends[p] = i + right
                if left + p + right >= least:
                    found.add((j - left, left + p + right, p))
    return sorted(found), compared


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of each word among the distinct ones in order of their bytes; the words are all that isn't space."""
    to = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(data[NOT_SPACE[data]])])
    return pc.rank(words, tiebreaker="dense").to_numpy().astype(np.int64)


def stretches(rank: np.ndarray, first: np.ndarray, least: int = LEAST, rounds: int = 16) -> list[tuple[int, int]]:
    """Spans of words, none over two texts (of which `first` are the offsets), that hold all runs whole. Fewer rounds leave
    longer ones."""
    n = len(rank)
    if not n:
        return []
    order = np.argsort(rank, kind="stable")
    far = np.full(n, n + 1)
    equal = rank[order][1:] == rank[order][:-1]
    far[order[1:][equal]] = (order[1:] - order[:-1])[equal]
    text = np.searchsorted(first, np.arange(n), "right") - 1
    live = np.flatnonzero(np.arange(n) - far >= first[text])
    for _ in range(rounds):
        new = np.ones(len(live), bool)
        new[1:] = (live[1:] != live[:-1] + 1) | (text[live[1:]] != text[live[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(live)))
        own = np.repeat(size, size)
        stay = (far[live] <= own) & (own >= (least + 1) // 2)
        if stay.all():
            break
        live = live[stay]
    if not len(live):
        return []
    new = np.ones(len(live), bool)
    new[1:] = (live[1:] != live[:-1] + 1) | (text[live[1:]] != text[live[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(live)))
    a, b = live[head], live[head] + size
    out: list[tuple[int, int]] = []
    for lo, hi in zip(np.maximum(a - size, first[text[a]]).tolist(), b.tolist(), strict=True):
        while out and out[-1][1] > lo:
            lo = min(lo, out.pop()[0])
        out.append((lo, hi))
    return out


def word_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start, then period), collapsed: the text's words, without
    those in a run behind its first `period` words, joined by one space. Words are `[^\\x20\\x09-\\x0D]+`; no text leaves its row."""
    source = columns(documents, "doc_id", "text")
    kind = dict(source.dtypes)["doc_id"]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_blocks(batch.column(1)):
                starts, ends, first = word_spans(data, at, NOT_SPACE)
                texts = np.searchsorted(first, np.arange(len(starts)), "right") - 1
                keep = np.zeros(len(starts) + 1, np.int64)  # changes of the number of runs that drop a word
                rows, values = [], []
                rank = ranks(data, starts, ends)
                for a, b in stretches(rank, first, least):
                    k = int(texts[a])
                    for start, length, period in runs_of(rank[a:b].tolist(), least)[0]:
                        rows.append(k)
                        values.append((a + start - int(first[k]), length, period))
                        keep[a + start + period] += 1
                        keep[a + start + length] -= 1
                kept = np.cumsum(keep[:-1]) == 0
                flat, to = joined(data, starts[kept], ends[kept], texts[kept], len(at) - 1)
                counts = np.bincount(np.array(rows, np.int64), minlength=len(at) - 1)
                table = np.array(values, np.int64).reshape(-1, 3)
                table = table[np.lexsort((table[:, 2], table[:, 0], np.array(rows, np.int64)))]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in table.T], fields=list(run)))
                text = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(to), pa.py_buffer(flat)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), lists, text], ["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, joined by one space within each of n texts, and the texts' offsets."""
    later = np.zeros(len(starts), np.int64)
    later[1:] = texts[1:] == texts[:-1]
    size = ends - starts + later
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 32, np.uint8)
    source = np.repeat(starts - later - to[:-1], size) + np.arange(to[-1])
    own = np.ones(to[-1], bool)
    own[to[:-1][later > 0]] = False
    out[own] = data[source[own]]
    return out, to[np.searchsorted(texts, np.arange(n + 1))].astype(np.int64)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_repetitions(documents: DataFrame) -> DataFrame:
    """The documents (doc_id, text), of which those with h % 10 = 0 (h the crc32 of the id's digits, g = h div 10) repeat words: each
    word i >= a becomes a + (i - a) % p, for a = g % n and p = 1 + (n - a) div (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    new = _bound(words, lambda w: F.when(F.size(w) > 0, changed(w)).otherwise(F.lit("")))
    return columns(documents, "doc_id", "text").select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of the documents, some of which repeat words by rule; the longest one and digests of all and of what is left."""
    found = word_runs(with_repetitions(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("m"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    start, period = -F.col("m.s"), -F.col("m.p")
    return rows.select("doc_id", "n_runs", start.alias("start"), F.col("m.length").alias("length"), period.alias("period"), F.floor(F.col("m.length") * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


#: Places where six words repeat at a distance make stretches of that period; a stretch in one of a smaller period isn't a run.
OP11_SQL = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM documents, tab),
len AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AS odd, h // 10 AS g FROM doc),
par AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM len),
word AS (
  SELECT doc_id, i, w[1 + CASE WHEN odd AND i >= a THEN a + (i - a) % p ELSE i END] AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM par)),
six AS (SELECT doc_id, i, [x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o, lead(x, 5) OVER o] AS s, lead(x, 5) OVER o IS NOT NULL AS whole FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
met AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM six l JOIN six r ON l.doc_id = r.doc_id AND l.s = r.s AND l.i < r.i WHERE l.whole AND r.whole),
isle AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM met) GROUP BY doc_id, q, k),
long AS (SELECT * FROM isle WHERE length >= greatest(12, 2 * q)),
run AS (
  SELECT * FROM long x WHERE NOT EXISTS (
    SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t, min((-length, start, q)) AS m FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, m[2]::BIGINT AS start, (-m[1])::BIGINT AS length, m[3]::BIGINT AS period, (-m[1] * 1000 // m[3])::BIGINT AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(left_.t, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM par LEFT JOIN listed USING (doc_id) LEFT JOIN left_ USING (doc_id)"""
