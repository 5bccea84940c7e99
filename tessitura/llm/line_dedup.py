"""Near-duplicate lines by a deletion-neighbourhood join: of lines at most one word apart, the earliest stays.

A line is its sequence of words, A-Z lowered. Equal lines meet by the hashes of the line and of its first half. Different
lines one word apart agree in their first or their second half, so lines that share no half with another can be left out at
no loss. All others are numbered in their order and emit their neighbourhood: the hash of the line without each of its
words, and of the line itself. Two lines are one word apart just if one is a variant of the other (a word more), or both
give the same variant without the same word (another word); so each line's earliest partner of a variant is found in one
pass over the sorted variants, and no pairs are made. The pairs of a line and what it would go for are then verified word
by word.

A line goes if an earlier one (by doc_id, then line) is equal, or is at most one word apart and both have at least
`near_words` words. Lines of fewer than `least_words` words always stay. What is earlier counts whether it stays or not.

Defined results: null texts stay null, empty ones empty; repeated rows (equal id and text) are one document and stay
alike; null ids come after all others; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.line_quality import lines
from tessitura.llm.shared import MEETINGS, apart, columns, digits, discard, held, meetings, text_blocks, written
from tessitura.llm.words import NOT_SPACE, Sequences, hashed_words, mix

#: At five words, one word apart is still 0.8 similar.
LEAST_WORDS, NEAR_WORDS = 4, 5
#: The pipeline's; its test holds that shorter lines go only if equal.
PIPELINE_NEAR_WORDS = 10
#: Rows of an Arrow batch.
BATCH = 1 << 16


def word_lines(data: np.ndarray, at: np.ndarray):
    """(hashes of word sequences, first word and word after the last of each line, line offsets of the texts)."""
    starts, _, first = lines(data, at)
    words, begin, _, _ = hashed_words(data, at, NOT_SPACE)
    a = np.searchsorted(begin, starts)
    return Sequences(words), a, np.append(a[1:], len(words)), first


def half_keys(sums: Sequences, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Three keys of each line; lines one word apart share one. They are the first halves and the second halves (by the
    shorter line's length n: n // 2 words, and the rest) that the line would have beside one of as many words or fewer."""
    n = b - a
    out = []
    for size, end in ((n // 2, False), ((n - 1) // 2, False), (n - n // 2, True), (n - 1 - (n - 1) // 2, True)):
        h = sums.spans(b - size, b) if end else sums.spans(a, a + size)
        out.append(mix(h + np.uint64(0xA0761D6478BD642F if end else 0)))
    # Of a line's four, two are the same: the first halves for odd n, the second ones for even n.
    return np.stack([out[0], np.where(n % 2 == 0, out[1], out[3]), out[2]], axis=1)


def variants(sums: Sequences, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the line, word left out, hash) of each line without each of its words, and of the line itself as -1."""
    size = b - a + 1
    of = np.repeat(np.arange(len(a)), size)
    p = digits(size) - 1
    out = np.empty(len(of), np.uint64)
    whole = p < 0
    out[whole] = sums.spans(a, b)
    out[~whole] = sums.without(a[of[~whole]], a[of[~whole]] + p[~whole], b[of[~whole]])
    return of, p, out


def near(x: list[str], y: list[str]) -> bool:
    """Whether two word sequences are at most one insertion, deletion or substitution apart."""
    if abs(len(x) - len(y)) > 1:
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return x[k + (len(x) >= len(y)) :] == y[k + (len(y) >= len(x)) :]


def _keyed(documents: DataFrame) -> list:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return [key.alias("_k"), F.xxhash64("text").alias("_mark")]


def _line_rows(documents: DataFrame, least: int) -> DataFrame:
    """doc_id, mark, line, h, n, keys of each line of at least `least` words."""
    source = columns(documents, "doc_id", "text").where("text is not null").withColumn("mark", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in text_blocks(batch.column(1)):
                sums, a, b, first = word_lines(data, at)
                line = digits(np.diff(first))
                text = np.repeat(np.arange(len(at) - 1), np.diff(first)) + lo
                some = b - a >= least
                a, b, line, text = a[some], b[some], line[some], pa.array(text[some])
                h, keys = sums.spans(a, b), half_keys(sums, a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(text), batch.column(2).take(text), pa.array(line.astype(np.int32)), pa.array(h.view(np.int64)), pa.array((b - a).astype(np.int32)), *(pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in range(3))], ["doc_id", "mark", "line", "h", "n", "k0", "k1", "k2"])

    return source.mapInArrow(work, f"doc_id {dict(source.dtypes)['doc_id']}, mark long, line int, h long, n int, k0 long, k1 long, k2 long")


def keepers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, keeper (an earlier line one word apart) from rows (v, p, id) sorted by these. In a run of v, the line that is the
    variant itself (p = -1) stands first, and in a run of v and p the earliest; only these are held, however long the run."""
    last = None  # v, p of the row before, the id of v's own line (or none), the least id of v and p
    none = np.iinfo(np.int64).max
    for batch in batches:
        v, p, own = (batch.column(k).to_numpy() for k in range(3))
        if not len(v):
            continue
        new_v, new_p = np.ones(len(v), bool), np.ones(len(v), bool)
        new_v[1:] = v[1:] != v[:-1]
        new_p[1:] = new_v[1:] | (p[1:] != p[:-1])
        new_v[0] = last is None or v[0] != last[0]
        new_p[0] = new_v[0] or p[0] != last[1]
        here = np.arange(len(v))
        head_v, head_p = (np.maximum.accumulate(np.where(x, here, -1)) for x in (new_v, new_p))
        line = np.where(p[np.maximum(head_v, 0)] < 0, own[np.maximum(head_v, 0)], none)
        least = own[np.maximum(head_p, 0)]
        if last is not None:
            line, least = np.where(head_v < 0, last[2], line), np.where(head_p < 0, last[3], least)
        best = np.where(p < 0, line, np.minimum(least, line))
        gone = best < own
        longer = new_p & (p >= 0) & (line != none) & (own < line)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[gone], line[longer]])), pa.array(np.concatenate([best[gone], own[longer]]))], ["id", "keeper"])
        last = (v[-1], p[-1], line[-1], least[-1])


def repeated_lines(documents: DataFrame, least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, mark (hash of the text), line, near: the lines that go, `near` telling those without an equal earlier one; and
    the tables that this reads, to be released once it has been read: held ones, and a written one at last."""
    rows = _line_rows(documents, least_words).persist(StorageLevel.DISK_ONLY)
    distinct = rows.groupBy("h", "k0").agg(F.count("*").alias("times"), F.min("n").alias("n"), F.min("k1").alias("k1"), F.min("k2").alias("k2"))
    distinct = held(distinct)

    # Lines that share a half with a different line; and those that occur more than once.
    halves = distinct.where(F.col("n") >= near_words).select(F.explode(F.array("k0", "k1", "k2")).alias("key"), F.col("h").alias("class"), F.lit(0).alias("n"))
    meet = halves.repartition("key").sortWithinPartitions("key", "class").mapInArrow(meetings, MEETINGS)
    meet = meet.select(F.col("class").alias("h")).distinct().withColumn("asked", F.lit(True))
    flagged = distinct.join(meet, "h", "left").where("times > 1 or asked").select("h", "k0", F.coalesce("asked", F.lit(False)).alias("asked"))
    lines_of = held(rows.select("doc_id", "mark", "line", "h", "k0").join(flagged, ["h", "k0"]))
    for table in (rows, distinct):
        table.unpersist()

    # Candidates are numbered in order, so a line is eight bytes from here on.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "line")
    first = held(lines_of.groupBy("h", "k0").agg(F.min(place).alias("first"), F.first("asked").alias("asked")))
    numbered = written(first.where("asked").orderBy("first").select(F.monotonically_increasing_id().alias("id"), "h", "k0", "first"), "numbered")
    asked = numbered.select(F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("_k"), F.col("first.mark").alias("_mark"), F.col("first.line").alias("line"), "id")
    asked = asked.groupBy("_k", "_mark").agg(F.collect_list(F.struct("line", "id")).alias("asked"))
    texts = columns(documents, "doc_id", "text").where("text is not null").select(*_keyed(documents), "text")

    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """v (variant), p (the word left out, -1 for the line itself), id, text (with the line itself)."""
        for batch in batches:
            wanted = batch.column(1)
            to = wanted.offsets.to_numpy()
            number, name = (wanted.values.field(k).to_numpy() for k in ("line", "id"))
            for lo, hi, data, at in text_blocks(batch.column(0)):
                sums, a, b, first = word_lines(data, at)
                starts, ends, _ = lines(data, at)
                raw = data.tobytes()
                text = np.repeat(np.arange(hi - lo), np.diff(to[lo : hi + 1]))
                k = first[text] + number[to[lo] : to[hi]]
                own = name[to[lo] : to[hi]]
                of, p, v = variants(sums, a[k], b[k])
                for x in range(0, len(v), BATCH):
                    y = min(x + BATCH, len(v))
                    words = [raw[starts[k[i]] : ends[k[i]]].decode("utf-8", "replace") if q < 0 else None for i, q in zip(of[x:y].tolist(), p[x:y].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(v[x:y].view(np.int64)), pa.array(p[x:y].astype(np.int32)), pa.array(own[of[x:y]]), pa.array(words, pa.string())], ["v", "p", "id", "text"])

    found = held(texts.join(asked, ["_k", "_mark"]).dropDuplicates(["_k", "_mark"]).select("text", "asked").mapInArrow(neighbourhoods, "v long, p int, id long, text string"))
    meet = found.select("v", "p", "id").repartition("v").sortWithinPartitions("v", "p", "id").mapInArrow(keepers, "id long, keeper long")
    pairs = meet.groupBy("id").agg(F.min("keeper").alias("other"))

    # Verified on the words themselves.
    text = found.where("p < 0").select("id", "text")
    both = pairs.join(text, "id").join(text.select(F.col("id").alias("other"), F.col("text").alias("text2")), "other").select("id", "text", "text2")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([t.as_py().encode().lower().split() for t in batch.column(k)] for k in (1, 2))
            ok = [near(a, b) for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["id"])

    gone = numbered.select("id", "h", "k0").join(both.mapInArrow(verify, "id long"), "id").select("h", "k0", F.lit(True).alias("near"))
    again = first.select("h", "k0", "first").join(gone, ["h", "k0"], "left")
    out = lines_of.join(again, ["h", "k0"]).where(F.col("near") | (place != F.col("first")))
    return out.select("doc_id", "mark", "line", (place == F.col("first")).alias("near")), [lines_of, first, found, numbered]


def deduplicated(documents: DataFrame, least_words: int = LEAST_WORDS, near_words: int = NEAR_WORDS, counts: bool = False) -> DataFrame:
    """The documents with their repeated lines taken out; with `counts` also n_lines, n_equal, n_near of each."""
    gone, tables = repeated_lines(documents, least_words, near_words)
    gone = written(gone.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("line", "near")).alias("_gone")), "gone")
    for table in tables[:-1]:
        table.unpersist()
    discard(tables[-1])
    names = documents.columns
    own = documents.select(*[F.col(f"`{n}`").alias(f"_{k}") for k, n in enumerate(names)], *_keyed(documents)).join(gone, ["_k", "_mark"], "left")
    own = own.select(*[f"_{k}" for k in range(len(names))], "_gone")
    place = names.index("text")
    types = dict(documents.dtypes)
    extra = ["n_lines", "n_equal", "n_near"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(place), batch.column(len(names))
            out, numbers = texts, np.zeros((3, batch.num_rows), np.int64)
            hit = np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False))
            if len(hit) or counts:
                values = texts.to_pylist()
                for i in range(len(values)) if counts else hit.tolist():
                    if values[i] is None:
                        continue
                    parts = values[i].split("\n")
                    drop = {x["line"]: x["near"] for x in lost[i].as_py()} if lost[i].is_valid else {}
                    numbers[:, i] = len(parts), len(drop) - sum(drop.values()), sum(drop.values())
                    if drop:
                        values[i] = "\n".join(x for k, x in enumerate(parts) if k not in drop)
                out = pa.array(values, pa.string())
            kept = [out if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, *([pa.array(x) for x in numbers] if counts else [])], [*(f"_{k}" for k in range(len(names))), *(f"_{x}" for x in extra if counts)])

    schema = ", ".join([*(f"_{k} {types[n]}" for k, n in enumerate(names)), *(f"_{x} long" for x in extra if counts)])
    made = own.mapInArrow(work, schema)
    return made.select(*[F.col(f"_{k}").alias(n) for k, n in enumerate(names)], *[F.col(f"_{x}").alias(x) for x in extra if counts])


def without_repeated_lines(documents: DataFrame, least_words: int = LEAST_WORDS, near_words: int = PIPELINE_NEAR_WORDS) -> DataFrame:
    """The documents without repeated lines, n_chars counted anew. Those of which nothing but white space is left go."""
    source, back = apart(documents, "doc_id", "text", "n_chars")
    out = deduplicated(source, least_words, near_words, counts=True)
    touched = F.col("n_equal") + F.col("n_near") > 0
    out = out.where(~touched | (F.trim(F.translate("text", "\t\n\r", "   ")) != ""))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return back(out)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    source = columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = deduplicated(source, counts=True)
    return out.select("doc_id", "n_lines", "n_equal", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: By halves and common ends in place of deletions: lines at most one word apart share the first or the second half that both
#: have by the shorter one's length m, and a common beginning and end that leave out one word of the longer line at most.
OP3_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
l AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text, k) AS id,
             regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM parts),
u AS (SELECT w, len(w) AS n, min(id) AS first FROM l WHERE len(w) >= 4 GROUP BY w),
a AS (SELECT w, n, first, n AS m FROM u WHERE n >= 5),
b AS (SELECT * FROM a UNION ALL SELECT w, n, first, n - 1 FROM a WHERE n >= 6),
h AS (SELECT first, n, m, m // 2 AS s, array_to_string(w[1:m // 2], ' ') AS one, array_to_string(w[n - (m - m // 2) + 1:n], ' ') AS two FROM b),
pair AS (
  SELECT x.first AS p, y.first AS q FROM h x JOIN h y ON x.m = y.m AND x.one = y.one AND x.first < y.first
  UNION SELECT x.first, y.first FROM h x JOIN h y ON x.m = y.m AND x.two = y.two AND x.first < y.first),
z AS (SELECT p, q, x.w AS v, y.w AS w FROM pair JOIN u x ON x.first = p JOIN u y ON y.first = q),
ends AS (
  SELECT q, greatest(len(v), len(w)) AS n,
         coalesce(nullif(list_position(list_transform(list_zip(v, w), lambda t: coalesce(t[1] = t[2], false)), false), 0) - 1, len(v)) AS i,
         coalesce(nullif(list_position(list_transform(list_zip(list_reverse(v), list_reverse(w)), lambda t: coalesce(t[1] = t[2], false)), false), 0) - 1, len(v)) AS j
  FROM z),
near AS (SELECT DISTINCT q AS first FROM ends WHERE i + j >= n - 1),
f AS (SELECT l.doc_id, l.text, l.k, l.line, u.first IS NOT NULL AND l.id <> u.first AS again, near.first IS NOT NULL AND l.id = u.first AS close
      FROM l LEFT JOIN u ON l.w = u.w LEFT JOIN near ON near.first = u.first),
g AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (again) AS n_equal, count(*) FILTER (close) AS n_near,
             coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT again AND NOT close), '') AS kept
      FROM f GROUP BY doc_id, text)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_equal, 0) AS n_equal, coalesce(n_near, 0) AS n_near, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM documents.doc_id AND g.text = documents.text
"""
