"""Mixing sources to target weights: every source gets a target in words, reached by whole epochs and then by a weighted
sample without replacement.

Targets: sources in order of their code points, null last, take the weights of `cycle` in turn and share `share` times all
words by them. A target stops at `most` times its source's size; what is over goes to the others by weight, until none is
above. That is the level at which the sum of min(most * size, level * weight) is the amount to share, found by rounds that
each are one sum over the table of sources.

Sample: a document with weight w has the key -ln(u) / w (Efraimidis and Spirakis; smallest first), u being uniform and
made of its id, so runs agree. Sorted by key within the source, a document is taken in the last, partial epoch if the middle
of its words lies below what the whole epochs leave of the target: the total is off by half of one document at most.

Nothing sorts a whole source. Keys fall into buckets by their logarithm (at most about one in 2,800 documents of equal weight
in one), sums of buckets say which one the target cuts, and only that one is sorted. Rows of equal key, id and size are
one entry with a count there, so a document that is repeated without end is no hot group; of one that is cut, copies are
numbered by partition.

Defined results: null texts have size 0, and documents of size 0 are taken 0 words; rows without id share one key and go by
size; repeated rows are documents of their own, and any so many of them are taken; weights that are missing, not finite or not
above 0 count as 1; further columns are ignored; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.shared import columns, discard, written

#: Words of `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
CYCLE, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Buckets of keys for each doubling of a key.
BUCKETS = 1024
SEED = "mix"


def _key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u of 52 bits of a digest of the seed and the id, in (0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def _numbered(sources: DataFrame) -> DataFrame:
    """The table of sources with `k`, the place of each from 0, by parts of a range: a part's rows are counted alone."""
    order = F.col("source").asc_nulls_last()
    parts = written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("own", own).join(before, "part").select("source", "source_size", (F.col("before") + F.col("own")).alias("k"))


def targets(sources: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST, rounds: int = 200) -> DataFrame:
    """source, source_size, target for a table of (source, source_size), one row for each source."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("k") % len(cycle)).cast("int"))
    table = written(_numbered(sources).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "weights")
    amount = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    for _ in range(rounds):
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        if full < 0:  # the first round caps none
            over = F.lit(False)
        held, left, n = table.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
        if n == full:
            break
        full, level = n, (amount - held) / left if left else float("inf")
    else:
        raise RuntimeError(f"targets did not settle in {rounds} rounds")
    return table.select("source", "source_size", F.least("cap", F.when(F.lit(level) == float("inf"), F.col("cap")).otherwise(F.lit(level) * F.col("weight"))).alias("target"))


def mixed(documents: DataFrame, weights: DataFrame | None = None, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) for documents (doc_id, text, source) and
    weights (doc_id, weight), of which the mean of an id's counts."""
    rows = columns(documents, "doc_id", "source", "text").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if weights is not None:
        own = columns(weights, "doc_id", "weight").where("doc_id is not null").groupBy("doc_id").agg(F.avg("weight").alias("weight"))
        rows = rows.join(own, "doc_id", "left")
    else:
        rows = rows.withColumn("weight", F.lit(None).cast("double"))
    good = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    rows = rows.withColumn("key", _key(F.col("doc_id"), F.when(good, F.col("weight")).otherwise(1.0), seed))
    sized = written(rows.select("doc_id", "source", "size", "key", F.floor(F.log2("key") * BUCKETS).cast("int").alias("bucket")), "sized")

    aimed = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aimed = aimed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    aimed = written(aimed, "targets")

    def of(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        """left joined to right where all named columns are equal, null to null; right's are left out."""
        on = [left[n].eqNullSafe(right[n]) for n in names]
        return left.join(right, on).select(*[left[n] for n in left.columns], *[right[n] for n in right.columns if n not in names])

    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = of(sums.withColumn("before", F.coalesce(before, F.lit(0))), aimed, "source")
    cut = sums.where("before < rest and before + words > rest").select("source", F.col("bucket").alias("at"), "before")
    # Buckets from the first that begins at or over the rest on aren't taken; without a cut, all before it are whole.
    last = sums.where("before < rest").groupBy("source").agg(F.max("bucket").alias("top"))
    plans = aimed.join(cut, aimed["source"].eqNullSafe(cut["source"]), "left").select(*[aimed[c] for c in aimed.columns], "at", F.coalesce("before", F.lit(0)).alias("before"))
    plans = written(plans.join(last, plans["source"].eqNullSafe(last["source"]), "left").select(*[plans[c] for c in plans.columns], "top"), "plans")
    rows = of(sized, plans, "source")
    out = [F.col("doc_id"), F.col("source"), F.col("size"), F.col("source_size"), F.col("target")]
    whole = F.coalesce(F.col("bucket") <= F.col("top"), F.lit(False))
    plain = rows.where("at is null or bucket <> at").select(*out, (F.col("size") * (F.col("epochs") + whole.cast("long"))).alias("taken"))

    edge = written(rows.where("bucket = at").select(*out, "epochs", "rest", "before", "key", F.spark_partition_id().alias("part")), "edge")
    entry = ("source", "key", "doc_id", "size")
    units = edge.groupBy(*entry).agg(F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(run), F.lit(0))
    take = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((F.col("rest") - start) / F.col("size") - 0.5)))).otherwise(0)
    units = written(units.select(*entry, "n", take.cast("long").alias("take")), "units")
    chosen = of(edge, units, *entry)
    settled = chosen.where("take = 0 or take = n").select(*out, (F.col("size") * (F.col("epochs") + (F.col("take") > 0).cast("long"))).alias("taken"))
    some = chosen.where("take > 0 and take < n")
    counts = some.groupBy(*entry, "part").agg(F.count("*").alias("here"))
    earlier = F.sum("here").over(Window.partitionBy(*entry).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*entry, "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy(*entry, "part").orderBy(F.lit(0)))
    numbered = of(some.withColumn("number", number), counts, *entry, "part")
    split = numbered.select(*out, (F.col("size") * (F.col("epochs") + (F.col("earlier") + F.col("number") <= F.col("take")).cast("long"))).alias("taken"))
    discard(aimed)
    return plain.union(settled).union(split)


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 1.5 for documents labelled good, 0.5 for those labelled bad."""
    return columns(labels, "doc_id", "quality").select("doc_id", (F.col("quality") + 0.5).alias("weight"))


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document, its source's size and target, and the words that the mix takes of it; weights from the labels."""
    weights = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights).select("doc_id", "size", "source_size", "target", "taken", "source")


OP13_SQL = rf"""
WITH w AS (SELECT doc_id, avg(quality + 0.5) AS weight FROM labels GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(weight, 1) AS weight,
             (('0x' || md5('{SEED}:' || coalesce(documents.doc_id::VARCHAR, 'null'))[:13])::BIGINT + 0.5) / 4503599627370496.0 AS u
      FROM documents LEFT JOIN w ON w.doc_id = documents.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source) AS k, 2.0 * source_size AS cap FROM s),
c AS (SELECT k, weight, cap, (1.5 * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY k) - cap)) / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY k) - weight)) AS level FROM r),
l AS (SELECT arg_min(level, k) AS level FROM c WHERE cap > level * weight),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM r, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / d.weight, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, size::BIGINT * (epochs + CASE WHEN before + size / 2.0 < rest THEN 1 ELSE 0 END) AS taken, source FROM p"""
