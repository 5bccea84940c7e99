"""Spelling variants: words one edit apart, joined by even partition and the pigeonhole principle, and for each word the
much more frequent one that it may stand for.

A word of length l is cut into two even segments. One inserted, deleted or replaced code point leaves one of them as it is,
so near words agree in an indexed word's segment: at the same place if both have l code points or the segment comes first,
shifted by one if the probing word has one more and the segment comes second. The other segment, where the edit is, is cut in
the same way, so that what agrees is three quarters of the word. An entry is thus an indexed length l, the part [p, q) that may
differ, and the word without it (without [p, q + 1) for a probing word of l + 1). Entries that agree are candidates; a
bounded edit distance verifies them, and a pair that several entries have met in is counted once.

A frequent segment makes no large group: where more than GROUP entries agree, the part that may differ is cut in two again
and again, to one code point at last. Then at most one indexed word for each letter agrees, whatever the words are.

A word's form is its most frequent near word, of equal ones the smallest, if that is `ratio` times as frequent at least. Counts
grow by that factor along forms, so the chain to a root is short (18 steps for ratio 10); it is followed in doubled steps.

Defined results: null and empty texts have no words; a null doc_id alters no run; a word that is alone has n_near 0 and is its own
root; repeated rows count as documents; further columns are ignored; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.shared import columns, discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: More entries than these that agree are told apart by smaller parts.
GROUP = 500
ENTRY = ("l", "p", "q", "kept")


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int | None = None) -> DataFrame:
    """word, n: maximal runs of letters, A-Z lowered, of `least_length` code points and `least_count` occurrences at least.
    With `dropped`, a run loses a code point where that divides the crc32 h of `<doc_id>:<run>`: the one at h % length."""
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run")
    runs = columns(documents, "doc_id", "text").select("doc_id", found).select("doc_id", F.translate("run", UPPER, LOWER).alias("word"))
    if dropped:
        runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % dropped == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _entries(rows: DataFrame, parts: Column) -> DataFrame:
    """A row for each part {l, p, q, longer} of each word, with what is kept of the word without the part."""
    out = rows.select("word", "n", F.explode(parts).alias("e")).select("word", "n", "e.*")
    kept = F.concat(F.substring("word", F.lit(1), F.col("p")), F.substring("word", F.col("q") + F.col("longer") + 1, F.length("word")))
    return out.withColumn("kept", kept)


def _part(l: Column, p: Column, q: Column, longer: Column) -> Column:
    return F.struct(l.cast("int").alias("l"), p.cast("int").alias("p"), q.cast("int").alias("q"), longer.cast("int").alias("longer"))


def _quarters(longer: int) -> list[Column]:
    """The four parts of an indexed word's length: the halves of both halves."""
    l = F.length("word") - longer
    half = F.floor(l / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((l - half) / 2), l]
    return [_part(l, a, b, F.lit(longer)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _met(entries: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of entries that agree and whose words are one edit apart; a is indexed."""
    index = entries.where("longer = 0").select(*ENTRY, F.col("word").alias("a"), F.col("n").alias("a_n"))
    probe = entries.select(*ENTRY, "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    candidates = index.join(probe, list(ENTRY)).where("(longer = 1 or a < b) and levenshtein(a, b, 1) = 1")
    return candidates.select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """a, a_n, b, b_n: each pair of words of (word, n) that are one edit apart, once."""
    entries = _entries(words, F.array(*_quarters(0), *_quarters(1)))
    found = None
    while True:
        large = written(entries.groupBy(*ENTRY).agg(F.count("*").alias("size")).where((F.col("size") > group) & (F.col("q") - F.col("p") > 1)).select(*ENTRY), "large")
        some = large.first() is not None
        pairs = _met(entries.join(large, list(ENTRY), "left_anti") if some else entries)
        found = pairs if found is None else found.union(pairs)
        if not some:
            discard(large)
            return found.distinct()
        middle = F.floor((F.col("p") + F.col("q")) / 2)
        halves = F.array(_part(F.col("l"), F.col("p"), middle, F.col("longer")), _part(F.col("l"), middle, F.col("q"), F.col("longer")))
        entries = written(_entries(entries.join(large, list(ENTRY), "left_semi"), halves), "entries")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (word, form), in steps that double."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after.select("word", "root")
        if after.where("moved").first() is None:
            return now


def variants(words: DataFrame, ratio: float = RATIO, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of (word, n); words must differ."""
    pairs = near_words(words, group)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.union(pairs.select("b", "b_n", "a", "a_n"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"), F.first("n").alias("own"))
    good = -F.col("best.m") >= F.col("own") * ratio
    near = written(near.select("word", "n_near", F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents, some of them misspelt by rule, with the words one edit from them."""
    return variants(written(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), dropped=31), "words"))


#: DuckDB has no crc32, so it is worked out byte by byte. Near words are found by taking out each code point in turn.
OP12_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
run AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
raw AS (SELECT run, n, doc_id, hex(encode(doc_id || ':' || run)) AS x FROM run WHERE length(run) >= 7),
crc AS (
  SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x), 2), lambda i: ('0x' || x[i + 1 : i + 2])::BIGINT)),
         lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) END AS h FROM raw, tab),
word AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM crc)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM less x JOIN less y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, w.word, w.n FROM less x JOIN word w ON w.word = x.a || x.b
  UNION SELECT w.word, w.n, x.word, x.n FROM less x JOIN word w ON w.word = x.a || x.b),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min((-near_n, encode(near))) AS m, arg_min(near, (-near_n, encode(near))) AS f FROM pair GROUP BY word),
form AS (SELECT word, n_near, CASE WHEN -m[1] >= 10 * n THEN f END AS form, CASE WHEN -m[1] >= 10 * n THEN -m[1] END AS form_n FROM best),
chain AS (
  SELECT word, form AS root, 1 AS k FROM form WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, form.form, k + 1 FROM chain JOIN form ON form.word = chain.root AND form.form IS NOT NULL),
root AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM word LEFT JOIN form USING (word) LEFT JOIN root USING (word)"""
