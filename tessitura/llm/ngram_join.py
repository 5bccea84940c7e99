"""Exact Jaccard self-join of documents on word 5-grams, by partitioning the universe of shingles.

A pair belongs to the size band of its smaller set. Sets that link differ in at most H shingles, a number that the band
bounds, so of H + 1 segments of the shingle universe one at least is equal in both. Each set indexes its subset of each
segment. A segment that is empty in both proves nothing and is not indexed; a set with E empty segments makes up for them:
the first segments that hold E subsets of two or more shingles also get all their subsets with one shingle deleted, so
there a difference of one is found as well.

Segments are taken in an order by cost that all sets of a band share: the number of deletions that all sets would index
there, measured over all documents, so segments of frequent shingles come last. A set of which no partner can differ in H
shingles takes only as many segments as its own partners need; those left out are the dearest. The order must be shared,
or a pair might choose different segments.

Equal sets are one class, so copies add no pairs. Entries meet by sorting; those of one class only are dropped. The
classes of an entry are verified against its smallest. Where that leaves an entry with several components, its classes are
compared by parity bitmaps, block by block in Arrow workers: entries with the same smallest class together, so a pair is
compared once and not for each entry that it shares. The classes with a close one in another component come together again
with their whole sets; of the links found there, a worker returns those that join components, fewer than it has classes. The
others lie within a component, so no pair of different texts is left out of account, and rows grow with the classes, not
with their pairs.

Classes are told apart by two 64-bit sums. Where two classes agree in the first, both are named by the second.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; a text of one to
four words is one shingle; repeated rows are copies; a null doc_id is never a component_id while another member has an
id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.components import components
from tessitura.llm.shared import MEETINGS, apart, columns, digits, discard, groups, meetings, text_blocks, written
from tessitura.llm.words import NOT_SPACE, chained, hashed_words, mix

WIDTH, PERCENT = 5, 80
#: Ratio of a band's limits.
BAND = 1.6
#: Bands of more segments than this take them in plain order, so the costs held are bounded.
COSTED = 1 << 16
#: Classes of entries with an equal smallest class that are compared at once.
BLOCK = 1024
#: Shingles of these classes, about; a larger set comes alone.
SHINGLES = 1 << 22
#: Rows of an Arrow batch.
BATCH = 1 << 16
#: Bits of a bitmap for each shingle, at least.
BITS = 8
#: Classes that may agree in the first sum.
AMBIGUOUS = 100_000


def limits(largest: int, percent: int) -> np.ndarray:
    """Lower limits of the size bands, up to beyond `largest`. Each band is wide enough for all partners above its edge."""
    out = [1, 2]
    while out[-1] <= largest:
        out.append(max(int(out[-1] * BAND) + 1, (out[-1] - 1) * 100 // percent + 1))
    return np.array(out, np.int64)


def differing(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The most shingles in which linked sets of at most a and b can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def shingles(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their offsets."""
    words, _, _, first = hashed_words(data, at, NOT_SPACE)
    grams = chained(words, width)
    sets, sizes = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        else:
            s = chained(words[a:b], b - a) if b > a else words[:0]
        sets.append(s)
        sizes.append(len(s))
    return (np.concatenate(sets) if sets else words[:0]), np.cumsum(sizes)


def class_ids(sets: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """One number for each set, equal for equal sets."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(seed)))])
    return mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A35)).view(np.int64)


def named(sets: np.ndarray, at: np.ndarray, ambiguous: np.ndarray) -> np.ndarray:
    """The class of each set: its first sum, or the second where the first is ambiguous."""
    first = class_ids(sets, at)
    return np.where(np.isin(first, ambiguous), class_ids(sets, at, 1), first) if len(ambiguous) else first


def memberships(size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(which sets, their band, segments of the band, segments that each set takes, the least that a partner takes): each set
    in its own band, where it is the smaller of a pair or both are, and as the larger one in the band below if a partner may
    lie there."""
    edges = limits(int(size.max(initial=1)) * 2, percent)
    own = np.searchsorted(edges, size, "right") - 1
    for lower in (False, True):
        band = np.maximum(own - lower, 0)
        least, largest = edges[band], edges[band + 1] - 1  # of the smaller set of a pair
        which = np.flatnonzero((size > 0) & ((own > 0) & (size * percent <= largest * 100) if lower else True))
        band, least, largest, n = band[which], least[which], largest[which], size[which]
        segments = band_segments(edges, band, percent)

        def taken(a: np.ndarray) -> np.ndarray:
            """By a smaller set: one more than it can differ from any partner in."""
            return np.minimum(segments, differing(a, a * 100 // percent, percent) + 1)

        mine = np.minimum(segments, differing(largest, n, percent) + 1) if lower else taken(n)
        partner = np.minimum(mine, taken(np.maximum(least, -(-n * percent // 100))))
        several = segments > 1
        yield which[several], band[several], segments[several], mine[several], partner[several]


def band_segments(edges: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    largest = edges[band + 1] - 1
    return differing(largest, largest * 100 // percent, percent) + 1


def dealt(sets: np.ndarray, at: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each shingle: hash ranges, so the sorted shingles of a segment stand together; and its set."""
    of = np.repeat(np.arange(len(segments)), np.diff(at))
    return ((sets >> np.uint64(32)) * segments[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64), of


def _subsets(sets: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen sets and their offsets."""
    size = np.diff(at)
    chosen = np.zeros(len(size), bool)
    chosen[which] = True
    return sets[np.repeat(chosen, size)], np.concatenate([[0], np.cumsum(size[which])])


class Order:
    """The place of each segment of a band in the order by cost; plain order for bands without costs."""

    def __init__(self, costs: dict[int, np.ndarray] | None = None):
        self.places: dict[int, np.ndarray] = {}
        for band, cost in (costs or {}).items():
            place = np.empty(len(cost), np.int64)
            place[np.argsort(cost, kind="stable")] = np.arange(len(cost))
            self.places[band] = place

    def of(self, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
        out = segment.copy()
        for b in np.unique(band).tolist():
            if b in self.places:
                own = band == b
                out[own] = self.places[b][segment[own]]
        return out


def entries(sets: np.ndarray, at: np.ndarray, segments: np.ndarray, taken: np.ndarray, partner: np.ndarray, band: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of the set) of the index entries of sets in the first `taken` of so many segments each.

    Of two sets the segments count that both take, at least `partner`. If these hold no equal subset and no difference of
    one that deletions find, then in fewer segments than are empty in both do the sets differ by more than one; so either a
    set's first segments of two or more shingles, as many as it has empty ones, show a link, or both have fewer of them than
    empty ones, and then their empty segments are indexed as well."""
    place, of = dealt(sets, at, segments)
    place = order.of(band[of], place)
    used = place < taken[of]
    base = np.concatenate([[0], np.cumsum(taken)])
    part = place[used] + base[of[used]]
    by = np.argsort(part, kind="stable")
    sets, part = sets[used][by], part[by]
    owner = np.repeat(np.arange(len(taken)), taken)
    at_place = np.arange(base[-1]) - base[owner]
    tag = mix(at_place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + band[owner].astype(np.uint64) * np.uint64(0xCA5A826395121157))
    count = np.bincount(part, minlength=base[-1])
    weight = mix(sets ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight)])
    ends = np.cumsum(count)
    total = sums[ends] - sums[ends - count]
    some, several = count > 0, count >= 2
    keys, owners = [mix(total[some] ^ tag[some])], [owner[some]]
    empty = np.bincount(owner, weights=~some, minlength=len(taken)).astype(np.int64)
    before = np.cumsum(several) - several
    first = np.concatenate([before, [several.sum()]])[base]
    chosen = several & (before - first[owner] < empty[owner])
    takes = chosen[part]
    keys.append(mix((total[part[takes]] - weight[takes]) ^ tag[part[takes]]))
    owners.append(owner[part[takes]])
    # More empty segments than such of several, among the first t for a t that a partner may have.
    excess = np.cumsum(~some) - np.cumsum(several)
    excess = excess - np.concatenate([[0], excess])[base[:-1]][owner]
    short = np.flatnonzero((excess > 0) & (at_place + 1 >= partner[owner]))
    last = np.zeros(len(taken), np.int64)
    last[owner[short]] = at_place[short] + 1
    lacking = ~some & (at_place < last[owner])
    keys.append(mix(tag[lacking]))
    owners.append(owner[lacking])
    return np.concatenate(keys), np.concatenate(owners)


def index(sets: np.ndarray, at: np.ndarray, percent: int, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of the set) over each set's bands."""
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for which, band, segments, taken, partner in memberships(np.diff(at), percent):
        if len(which):
            k, o = entries(*_subsets(sets, at, which), segments, taken, partner, band, order or Order())
            keys.append(k)
            owners.append(which[o])
    return np.concatenate(keys), np.concatenate(owners)


def costs(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, segment, shingles that stand there beside another of their set) for bands of up to COSTED segments."""
    out = [(np.zeros(0, np.int64),) * 3]
    for which, band, segments, *_ in memberships(np.diff(at), percent):
        which, band, segments = (x[segments <= COSTED] for x in (which, band, segments))
        if not len(which):
            continue
        own, to = _subsets(sets, at, which)
        place, of = dealt(own, to, segments)
        base = np.concatenate([[0], np.cumsum(segments)])
        count = np.bincount(place + base[of], minlength=base[-1])
        some = np.flatnonzero(count >= 2)
        owner = np.searchsorted(base, some, "right") - 1
        key, inverse = np.unique(band[owner] << 32 | some - base[owner], return_inverse=True)
        out.append((key >> 32, key & 0xFFFFFFFF, np.bincount(inverse, weights=count[some], minlength=len(key)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def classes(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a hash of the text), class, other (both sums), n_shingles for each document; and rows with band,
    segment, cost instead, each batch's sums."""
    source = columns(documents, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    numbers = ("mark", "class", "other", "n_shingles", "band", "segment", "cost")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}

        def told(ids: pa.Array, n: int, **values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(values[k], pa.int64()) if k in values else pa.nulls(n, pa.int64()) for k in numbers)], ["doc_id", *numbers])

        def tally() -> pa.RecordBatch:
            key = np.fromiter(seen.keys(), np.int64, len(seen))
            cost = np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            return told(pa.nulls(len(key), kind), len(key), band=key >> 32, segment=key & 0xFFFFFFFF, cost=cost)

        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for lo, hi, data, at in text_blocks(batch.column(1)):
                sets, to = shingles(data, at, width)
                for b, s, c in zip(*(x.tolist() for x in costs(sets, to, percent)), strict=True):
                    seen[b << 32 | s] = seen.get(b << 32 | s, 0) + c
                yield told(batch.column(0).slice(lo, hi - lo), hi - lo, mark=batch.column(2).slice(lo, hi - lo), **{"class": class_ids(sets, to), "other": class_ids(sets, to, 1), "n_shingles": np.diff(to)})
                if len(seen) > BATCH:
                    yield tally()
        if seen:
            yield tally()

    return source.mapInArrow(work, f"doc_id {dict(source.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in numbers))


def measured(docs: DataFrame, percent: int) -> Order:
    """The order of segments from the costs in `classes`; their number is bounded by COSTED for each band."""
    rows = docs.where("band is not null").groupBy("band", "segment").agg(F.sum("cost").alias("cost")).toArrow()
    band, segment, cost = (rows[k].to_numpy() for k in ("band", "segment", "cost"))
    found = np.unique(band)
    number = band_segments(limits(1 << 40, percent), found, percent)
    out = {b: np.zeros(n, np.int64) for b, n in zip(found.tolist(), number.tolist(), strict=True)}
    for b in out:
        out[b][segment[band == b]] = cost[band == b]
    return Order(out)


def indexed(documents: DataFrame, width: int, percent: int, order: Order, ambiguous: np.ndarray) -> DataFrame:
    """key, class, n: the entries of the classes of each batch."""
    held = documents.sparkSession.sparkContext.broadcast((order, ambiguous))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, ambiguous = held.value
        for batch in batches:
            seen: set[int] = set()
            for _, _, data, at in text_blocks(batch.column(0)):
                sets, to = shingles(data, at, width)
                own, size = named(sets, to, ambiguous), np.diff(to)
                new = np.flatnonzero([not (c in seen or seen.add(c)) for c in own.tolist()])
                k, o = index(*_subsets(sets, to, new), percent, order)
                for lo in range(0, len(k), BATCH):
                    one = new[o[lo : lo + BATCH]]
                    yield pa.RecordBatch.from_arrays([pa.array(k[lo : lo + BATCH].view(np.int64)), pa.array(own[one]), pa.array(size[one].astype(np.int32))], ["key", "class", "n"])

    return columns(documents, "text").mapInArrow(work, "key long, class long, n int")


def sketches(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of a parity bitmap of each set, BITS bits for each shingle at least, and their offsets. Each shingle
    flips one bit, so bitmaps never differ in more bits than the sets differ in shingles. The number of bits is a power of
    two; a larger bitmap folds to a smaller one."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, BITS * np.diff(at)))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    of = np.repeat(np.arange(len(bits)), np.diff(at))
    place = (sets & (bits[of] - 1).astype(np.uint64)).astype(np.int64) + base[of]
    flips = np.bincount(place, minlength=base[-1]) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64), base // 64


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows) brought down to `size` words."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _rows(column: pa.ListArray, which: np.ndarray) -> np.ndarray:
    """Lists of one length as rows."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy()
    size = int(at[which[0] + 1] - at[which[0]])
    return values[at[which][:, None] + np.arange(size)[None, :]].view(np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets link. Bitmaps rule out most others before whole sets are looked up."""
    a, b = (sets.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    told = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(k).to_numpy() for k in (2, 3)]
            most = differing(*n, percent)
            lists = [batch.column(k) for k in (4, 5)]
            wide = [np.diff(c.offsets.to_numpy()) for c in lists]
            ok = np.zeros(batch.num_rows, bool)
            for x, y in np.unique(np.stack(wide), axis=1).T.tolist():
                own = np.flatnonzero((wide[0] == x) & (wide[1] == y) & (100 * np.minimum(*n) >= percent * np.maximum(*n)))
                for lo in range(0, len(own), 2048):
                    k = own[lo : lo + 2048]
                    ok[k] = np.bitwise_count(folded(_rows(lists[0], k), min(x, y)) ^ folded(_rows(lists[1], k), min(x, y))).sum(axis=1) <= most[k]
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = told.mapInArrow(close, "a long, b long")
    a, b = (sets.select(F.col("class").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    same = F.size(F.array_intersect("ga", "gb"))
    return left.join(a, "a").join(b, "b").where(100 * same >= percent * (F.size("ga") + F.size("gb") - same)).select("a", "b").distinct()


def _close(table: pa.Table, lists: pa.ListArray, component: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(a row, rows close to it) of a group: those of other components whose bitmaps (`lists`) don't rule out a link. A group is
    compared within itself, or its `first` with its `second` rows. What the caller changes in `component` holds from the next
    row on."""
    name, n, first, second = (table[k].to_numpy() for k in ("class", "n", "first", "second"))
    within = (first & second).all()
    wide = np.diff(lists.offsets.to_numpy())
    for w in np.unique(wide).tolist():
        right = np.flatnonzero((wide == w) & second)
        if not len(right):
            continue
        right = right[np.argsort(n[right], kind="stable")]
        b = _rows(lists, right)
        for v in (w // 2, w, 2 * w):
            left = np.flatnonzero((wide == v) & first)
            for i in left.tolist():
                lo = np.searchsorted(n[right], -(-int(n[i]) * percent // 100), "left")
                hi = np.searchsorted(n[right], int(n[i]) * 100 // percent, "right")
                own = right[lo:hi]
                keep = np.flatnonzero((component[own] != component[i]) & (name[own] > name[i] if within else True))
                if not len(keep):
                    continue
                x = folded(_rows(lists, np.array([i])), min(v, w))
                for cut in range(0, len(keep), 4096):
                    k = keep[cut : cut + 4096]
                    d = np.bitwise_count(folded(b[lo + k], min(v, w)) ^ x).sum(axis=1)
                    hit = own[k[d <= differing(n[own[k]], n[i], percent)]]
                    if len(hit):
                        yield i, hit


def _whole(column: pa.ChunkedArray) -> pa.ListArray:
    lists = column.combine_chunks()
    return lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists


def _joining(table: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """Linked rows of a group that bring all its components together that any links do: one link less than components at most."""
    component = table["component"].to_numpy().copy()
    lists = _whole(table["grams"])
    at, sets = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(np.uint64)
    sets, at = sets[at[0] : at[-1]], at - at[0]
    words, cuts = sketches(sets, at)
    for i, hit in _close(table, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(words)), component, percent):
        own, n = sets[at[i] : at[i + 1]], at[hit + 1] - at[hit]
        theirs = sets[np.repeat(at[hit], n) + digits(n)]
        same = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, np.cumsum(n) - n, dtype=np.int64)
        for k in hit[100 * same >= percent * (len(own) + n - same)].tolist():
            if component[k] != component[i]:
                component[component == component[k]] = component[i]
                yield i, k


def _more_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: linked classes that join the components of each group g of `rows` (g, class, n, component, first, second). Bitmaps
    tell which rows have a close one; whole sets come together for these only. A group never makes more rows than it has."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            found = np.zeros(table.num_rows, bool)
            for i, hit in _close(table, _whole(table["sketch"]), table["component"].to_numpy(), percent):
                found[i] = found[hit] = True
            if found.any():
                yield from table.drop_columns("sketch").filter(pa.array(found)).combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            name = table["class"].to_numpy()
            pairs = np.array(list(_joining(table, percent)), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.sort(name[pairs], axis=1).T.copy()], ["a", "b"])

    together = lambda df: df.repartition("g").sortWithinPartitions("g")
    close = together(rows.join(sets.select("class", "sketch"), "class").select(*rows.columns, "sketch")).mapInArrow(near, rows.schema)
    return together(close.join(sets.select("class", "grams"), "class").select(*rows.columns, "grams")).mapInArrow(work, "a long, b long").distinct()


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Groups (see `_more_links`) of the entries whose classes are not all in one component."""
    label = shared.join(found, F.col("class") == F.col("node"), "left").select("key", "class", "n", "low", F.coalesce("component", "class").alias("component"))
    mixed = label.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    member = written(label.join(mixed, "key").select("low", "class", F.col("n").cast("long").alias("n"), "component").distinct(), "mixed")
    blocks = member.groupBy("low").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    member = member.join(blocks, "low").withColumn("i", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    member = member.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return member.select(F.xxhash64("low", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "class", "n", "component", (F.col("i") <= F.col("j")).alias("first"), (F.col("i") >= F.col("j")).alias("second"))


def _labelled(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_shingles, component_id, component (a class of it) for each document."""
    rows = written(classes(documents, width, percent), "classes")
    docs = rows.where("n_shingles is not null").select("doc_id", "mark", "class", "other", "n_shingles")
    unclear = docs.groupBy("class").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x < y").select("class")
    ambiguous = np.array([r[0] for r in unclear.limit(AMBIGUOUS).collect()], np.int64)
    if len(ambiguous) == AMBIGUOUS:
        raise RuntimeError(f"{AMBIGUOUS} or more sets share a hash with another")
    if len(ambiguous):
        docs = docs.withColumn("class", F.when(F.col("class").isin(ambiguous.tolist()), F.col("other")).otherwise(F.col("class")))
    docs = docs.drop("other")
    entry = indexed(documents, width, percent, measured(rows, percent), ambiguous).repartition("key").sortWithinPartitions("key", "class")
    shared = written(entry.mapInArrow(meetings, MEETINGS), "entries")

    # Each entry's classes against its smallest.
    alike = 100 * F.least("n", "low_n").cast("long") >= percent * F.greatest("n", "low_n").cast("long")
    stars = written(shared.where((F.col("class") != F.col("low")) & alike).select(F.col("low").alias("a"), F.col("class").alias("b")).distinct(), "stars")

    # The sets of classes that share an entry, from one document of each.
    wanted = shared.select("class").distinct()
    one = docs.join(wanted, "class").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("d"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    one = one.select("class", F.col("d.doc_id").alias("doc_id"), F.col("d.mark").alias("mark")).select("class", key.alias("_k"), "mark")
    texts = columns(documents, "doc_id", "text").select(key.alias("_k"), F.xxhash64("text").alias("mark"), "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in text_blocks(batch.column(1)):
                sets, to = shingles(data, at, width)
                words, cuts = sketches(sets, to)
                lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(v)) for v, c in ((sets.view(np.int64), to), (words, cuts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(to)), *lists], ["class", "n", "grams", "sketch"])

    sets = written(texts.join(one, ["_k", "mark"]).dropDuplicates(["class"]).select("class", "text").mapInArrow(grams, "class long, n long, grams array<long>, sketch array<long>"), "sets")
    links = written(_verified(stars, sets, percent), "links")
    found = written(components(links), "found")
    more = written(_more_links(_apart(shared, found), sets, percent), "more")
    if more.take(1):
        found = written(components(links.union(more)), "found")
    for table in (shared, stars, sets):
        discard(table)

    # The smallest document of each class and of each component.
    by_class = docs.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    by_class = by_class.join(found, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("c"))
    by_component = by_class.groupBy("c").agg(F.min("least").alias("component_id"))
    label = by_class.join(by_component, "c").select("class", "component_id", F.col("c").alias("component"))
    return docs.join(label, "class", "left").select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_shingles, component_id for each document."""
    return _labelled(documents, width, percent).drop("component")


def one_of_each(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group: of those with the smallest id (without id, where none has one) the one whose text has the
    smallest hash, and one of its repeated rows. Texts without words stay."""
    label = _labelled(documents, width, percent).where("n_shingles > 0").groupBy("doc_id", "mark", "component_id", "component").agg(F.count("*").alias("n"))
    label = written(label, "labelled")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    best = label.where(own).groupBy("component").agg(F.min("mark").alias("best"))
    label = label.join(best, "component").withColumn("stays", own & (F.col("mark") == F.col("best")))
    source, back = apart(documents, "doc_id", "text")
    # A prefix tells an empty id from none.
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    gone = label.where("not stays").select(key.alias("_k"), F.col("mark").alias("_mark"))
    again = written(label.where("stays and n > 1").select(key.alias("_k"), F.col("mark").alias("_mark")), "repeated")
    same = (key == F.col("_k")) & (F.xxhash64("text") == F.col("_mark"))
    if not again.take(1):
        return back(source.join(gone, same, "left_anti"))
    alone = source.join(gone.union(again), same, "left_anti")
    row = F.struct(*source.columns)
    once = source.join(again, same).select("_k", "_mark", row.alias("_row")).groupBy("_k", "_mark").agg(F.first("_row").alias("_row"))
    return back(alone.union(once.select("_row.*")))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT doc_id, g FROM s SEMI JOIN often USING (g)),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i))
, reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
  SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id
"""
