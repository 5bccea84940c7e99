"""Near-duplicate embeddings by NN-descent within labels.

Equal vectors are one node. The first neighbour lists come from random hyperplanes: nodes of one label and sign code are
compared in blocks, in several tables. Their number follows from the code's width, so that a pair at the threshold meets in no
table with a chance of MISS at most; a bucket of more than a block is told apart by further signs, and only what they leave
together is dealt into blocks at random. Rounds of NN-descent follow: every node's neighbours and those that list it are
compared with each other, and lists keep their best. Lists hold `k` entries, and where these all reach the threshold
(saturated lists) up to twice, four times ... as many of that kind. Edges that reach the threshold make components. A link
that was seen is lost only if both its nodes' lists are saturated, so components are joined over all nodes of saturated lists:
these are compared block by block, but for blocks too far apart for their radii. At last a component's members are compared in
blocks of thousands, a strip at a time, and links counted, so no pair becomes a row and none within a component is missed.

Recall is audited, at every size alike: one node in `audit`, and AUDITED at most, is compared with all nodes of its label. Edge
recall is the share of the links seen there that lie in one component. Below the aim, further tables and rounds without a
floor follow; if it stays under LEAST_RECALL, that is an error. Links that the audit finds are used. Where few audited nodes
link, a second audit takes more, up to the same number; a table of which none links is not compared any further. What was
audited goes to the log, and to `report` if that is given.

Defined results: null, zero, non-finite or partly null vectors and rows without label link with nothing; vectors of
different dimensions don't link; repeated rows are vectors of their own that link (if valid); a null vec_id is a
component's id only if no member has one; further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.components import components
from tessitura.llm.shared import columns, groups, written

LOG = logging.getLogger(__name__)
THRESHOLD, K, ROUNDS = 0.98, 10, 2
#: The chance that a pair at the threshold meets in no table, and the most tables.
MISS, MOST_TABLES = 1e-4, 64
#: Signs of a code, and further ones for buckets of more than a block.
BITS, MORE_BITS = 24, 24
#: Nodes compared at once, and a bucket's aim.
BLOCK, BUCKET = 512, 64
#: Neighbours below this cosine aren't listed or followed in the first rounds.
FLOOR = 0.9
#: One node in so many is audited, and so many at most; the edge recall below which more rounds follow, and that below which a
#: result is refused; the links that are enough to judge it, and how many times more nodes are audited where there are fewer.
AUDIT, AUDITED, AIM, LEAST_RECALL, ENOUGH, FURTHER = 50, 8192, 0.999, 0.9, 100, 5


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one dimension as doubles, and their norms."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x, np.sqrt((x * x).sum(axis=1))


def cosines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (a[0] @ b[0].T) / np.outer(a[1], b[1])


def _together(df: DataFrame) -> DataFrame:
    return df.repartition("g").sortWithinPartitions("g")


def nodes(embeddings: DataFrame) -> DataFrame:
    """c (node), label, dim, v, m (rows), least (smallest vec_id) of the different valid vectors of each label."""
    good = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = columns(embeddings, "vec_id", "label", "embedding").where(F.col("label").isNotNull() & good)
    alike = rows.groupBy("label", F.col("embedding").alias("v")).agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    return alike.select(F.xxhash64("label", "v").alias("c"), "label", F.size("v").alias("dim"), "v", "m", "least")


def tables_for(width: int, threshold: float, miss: float = MISS) -> int:
    """Tables of so many signs of which a pair at the threshold shares a bucket in one at least, but for a chance of `miss`."""
    agree = (1 - np.arccos(threshold) / np.pi) ** width
    return 1 if agree >= 1 - miss else int(min(MOST_TABLES, np.ceil(np.log(miss) / np.log1p(-agree))))


def _coded(node: DataFrame, seed: int, widths: dict, usual: int, threshold: float, tables: int | None) -> DataFrame:
    """c, label, dim, v, t, code, rest: each node once for every table of its label, with its bucket and further signs."""
    label = dict(node.dtypes)["label"]
    number = {w: tables or tables_for(w, threshold) for w in {usual, *widths.values()}}
    most = max(number.values())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dim = batch.column(2).to_numpy()
            for d in np.unique(dim).tolist():
                of = batch.filter(pa.array(dim == d))
                if d not in planes:
                    planes[d] = np.random.default_rng(seed).normal(size=(d, most, BITS + MORE_BITS))
                x, _ = matrix(of.column(3))
                width = np.array([widths.get(b, usual) for b in of.column(1).to_pylist()], np.int64)
                last = np.array([number[w] for w in width.tolist()], np.int64)
                for t in range(most):
                    some = np.flatnonzero(last > t)
                    if not len(some):
                        break
                    own = of.take(pa.array(some))
                    signs = x[some] @ planes[d][:, t] > 0
                    inside = np.arange(BITS)[None, :] < width[some][:, None]
                    code, rest = ((s << np.arange(s.shape[1])).sum(axis=1).astype(np.int64) for s in (signs[:, :BITS] & inside, signs[:, BITS:]))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), own.column(3), pa.array(np.full(len(some), t, np.int32)), pa.array(code), pa.array(rest)], ["c", "label", "dim", "v", "t", "code", "rest"])

    return node.select("c", "label", "dim", "v").mapInArrow(work, f"c long, label {label}, dim int, v array<float>, t int, code long, rest long")


EDGE = "u long, w long, s double"


def _edge_batch(u: list[np.ndarray], w: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, w, s)], ["u", "w", "s"])


def _bucket_lists(coded: DataFrame, k: int, floor: float) -> DataFrame:
    """Of the best `k` of each node in its block of a bucket, those that reach the floor. Larger buckets are told apart by so
    many further signs as would leave a block, and what is still larger is dealt into blocks at random. What a node is
    listed by in a block, but doesn't list, is no better than all it lists there."""
    coded = written(coded.withColumn("b", F.xxhash64("label", "dim", "t", "code")), "coded")

    def large(rows: DataFrame) -> DataFrame:
        return rows.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)

    signs = F.least(F.ceil(F.log2(F.col("n") / BLOCK)).cast("int"), F.lit(MORE_BITS))
    finer = F.xxhash64("b", F.pmod(F.col("rest"), F.pow(F.lit(2.0), signs).cast("long")))
    split = coded.join(large(coded), "b", "left").select("c", "v", "t", F.when(F.col("n").isNull(), F.col("b")).otherwise(finer).alias("b"))
    dealt = split.join(large(split), "b", "left").select("c", "v", F.xxhash64("b", F.pmod(F.xxhash64("c", "t"), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK))).alias("g"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, w, s, held = [], [], [], 0
        for table in groups(batches):
            n = table.num_rows
            if n < 2:
                continue
            c = table["c"].to_numpy()
            for lo in range(0, n, 2 * BLOCK):
                part = table.slice(lo, 2 * BLOCK)
                x = matrix(part["v"])
                own = c[lo : lo + 2 * BLOCK]
                sim = cosines(x, x)
                np.fill_diagonal(sim, -2)
                m = min(k, len(own) - 1)
                if m < 1:
                    continue
                best = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                value = np.take_along_axis(sim, best, axis=1).ravel()
                some = np.flatnonzero(value >= floor)
                u.append(np.repeat(own, m)[some])
                w.append(own[best].ravel()[some])
                s.append(value[some])
                held += len(some)
            if held > 50_000:
                yield _edge_batch(u, w, s)
                u, w, s, held = [], [], [], 0
        if held:
            yield _edge_batch(u, w, s)

    return _together(dealt).mapInArrow(work, EDGE)


def _best(edges: DataFrame, k: int, larger: int, threshold: float) -> DataFrame:
    """Each node's list from its edges (u to w): the best k, and up to `larger` that reach the threshold."""
    edges = edges.where("u <> w").groupBy("u", "w").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "w"))
    return edges.withColumn("r", rank).where(f"r <= {larger}").where((F.col("r") <= k) | (F.col("s") >= threshold)).drop("r")


def _descent(lists: DataFrame, node: DataFrame, k: int, larger: int, floor: float) -> DataFrame:
    """New edges among the neighbours of each node, and those that list it, from each node whose list they improve."""
    near = lists.where(F.col("s") >= floor)
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("s"), "u"))
    listed = near.withColumn("r", rank).where(f"r <= {larger}").select(F.col("w").alias("g"), F.col("u").alias("c"))
    member = near.select(F.col("u").alias("g"), F.col("w").alias("c")).union(listed).distinct()
    # The worst entry of each list, beyond which an edge improves it.
    worst = lists.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("n")).select(F.col("u").alias("c"), F.when(F.col("n") >= k, F.col("worst")).otherwise(-1.0).alias("worst"))
    rows = member.join(node.select("c", "v").join(worst, "c", "left"), "c").select("g", "c", "v", F.coalesce("worst", F.lit(-1.0)).alias("worst"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, w, s, held = [], [], [], 0
        for table in groups(batches):
            if table.num_rows < 2:
                continue
            c, worst = table["c"].to_numpy(), table["worst"].to_numpy()
            x = matrix(table["v"])
            sim = cosines(x, x)
            np.fill_diagonal(sim, -2)
            i, j = np.nonzero((sim > worst[:, None]) & (sim >= floor))
            if len(i):
                u.append(c[i])
                w.append(c[j])
                s.append(sim[i, j])
                held += len(i)
            if held > 50_000:
                yield _edge_batch(u, w, s)
                u, w, s, held = [], [], [], 0
        if held:
            yield _edge_batch(u, w, s)

    return _together(rows).mapInArrow(work, EDGE)


def _pieces(node: DataFrame, lists: DataFrame, found: DataFrame, k: int, threshold: float) -> DataFrame:
    """c, v, label, dim, component, piece: the nodes of saturated lists, each component's dealt into pieces of about a block."""
    full = lists.where(F.col("s") >= threshold).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("u").alias("node"))
    member = found.join(full, "node", "left_semi")
    size = member.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
    piece = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("pieces")))
    member = member.join(size, "component").select(F.col("node").alias("c"), "component", piece.alias("piece"))
    return node.select("c", "v", "label", "dim").join(member, "c")


def _balls(pieces: DataFrame) -> DataFrame:
    """piece, component, label, dim, v (centre), radius (angle) of each piece."""
    label = dict(pieces.dtypes)["label"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            x, norm = matrix(table["v"])
            x = x / norm[:, None]
            centre = x.mean(axis=0)
            if centre @ centre < 1e-12:
                centre = x[0]
            radius = np.arccos(np.clip(x @ centre / np.sqrt(centre @ centre), -1, 1)).max()
            one = table.slice(0, 1).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(one[n].chunk(0) for n in ("g", "component", "label", "dim")), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(radius)])], ["piece", "component", "label", "dim", "v", "radius"])

    return _together(pieces.withColumnRenamed("piece", "g")).mapInArrow(work, f"piece long, component long, label {label}, dim int, v array<double>, radius double")


def _close(balls: DataFrame, threshold: float) -> DataFrame:
    """a, b (pieces), x, y (their components), angle: pieces of different components that may hold a link."""
    size = balls.groupBy("label", "dim").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("blocks"))
    rows = balls.join(size, ["label", "dim"]).withColumn("i", F.pmod(F.xxhash64("piece"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("piece", "component", "v", "radius", (F.col("i") <= F.col("j")).alias("first"), (F.col("i") >= F.col("j")).alias("second"), F.xxhash64("label", "dim", F.least("i", "j"), F.greatest("i", "j")).alias("g"))
    reach = float(np.arccos(threshold)) + 1e-6

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            a, b = (table.filter(table[k]) for k in ("first", "second"))
            angle = np.arccos(np.clip(cosines(matrix(a["v"]), matrix(b["v"])), -1, 1))
            x, y = a["component"].to_numpy(), b["component"].to_numpy()
            ok = angle <= a["radius"].to_numpy()[:, None] + b["radius"].to_numpy()[None, :] + reach
            # Within one block each pair comes twice.
            i, j = np.nonzero(ok & ((x[:, None] < y[None, :]) if a.num_rows == b.num_rows == table.num_rows else (x[:, None] != y[None, :])))
            p, q = a["piece"].to_numpy()[i], b["piece"].to_numpy()[j]
            x, y, turned = x[i], y[j], x[i] > y[j]
            values = (np.where(turned, q, p), np.where(turned, p, q), np.where(turned, y, x), np.where(turned, x, y), angle[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["a", "b", "x", "y", "angle"])

    return _together(rows).mapInArrow(work, "a long, b long, x long, y long, angle double")


def _witnesses(pairs: DataFrame, pieces: DataFrame, threshold: float) -> DataFrame:
    """a, b: one link of each pair of pieces that has any."""
    g = F.xxhash64("a", "b").alias("g")
    side = pairs.select(g, F.col("a").alias("piece"), F.lit(True).alias("first")).union(pairs.select(g, F.col("b").alias("piece"), F.lit(False).alias("first")))
    rows = side.join(pieces.select("piece", "c", "v"), "piece").select("g", "first", "c", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            a, b = table.filter(table["first"]), table.filter(pa.array(~table["first"].to_numpy()))
            sim = cosines(matrix(a["v"]), matrix(b["v"]))
            i, j = np.unravel_index(np.argmax(sim), sim.shape)
            if sim[i, j] >= threshold:
                yield pa.RecordBatch.from_arrays([pa.array(a["c"].to_numpy()[[i]]), pa.array(b["c"].to_numpy()[[j]])], ["a", "b"])

    return _together(rows).mapInArrow(work, "a long, b long")


def _joined(node: DataFrame, lists: DataFrame, links: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Components of the links and of those between saturated lists, exactly; and the links that tell them. Of two components
    the nearest pieces are compared first, and all others only if these leave them apart."""
    found = written(components(links), "found")
    pieces = written(_pieces(node, lists, found, k, threshold), "pieces")
    if pieces.first() is None:
        return found, links
    close = written(_close(_balls(pieces), threshold), "close")
    nearest = close.groupBy("x", "y").agg(F.min(F.struct("angle", "a", "b")).alias("p")).select("p.a", "p.b")
    for final in (False, True):
        if final:
            label = found.toDF("a", "c").distinct()
            now = close.join(label.toDF("x", "cx"), "x").join(label.toDF("y", "cy"), "y").where("cx <> cy").select("a", "b")
        else:
            now = nearest
        more = written(_witnesses(now, pieces, threshold), "witnesses")
        if more.take(1):
            links = links.union(more)
            found = written(components(links), "found")
    return found, links


def _audited(node: DataFrame, found: DataFrame, step: int, parts: list[int], threshold: float) -> DataFrame:
    """c, w, n of every audited node c (of `step` parts these) that links: w is null, and n the number of links, for
    those in its component; for each other component (and block), w is a node that it links to there. Audited nodes and
    nodes of a label are compared block by block."""
    label = found.select(F.col("node").alias("c"), "component")
    rows = node.select("c", "label", "dim", "v").join(label, "c", "left").withColumn("component", F.coalesce("component", "c"))
    rows = rows.withColumn("asked", F.pmod(F.xxhash64("c", F.lit(1)), F.lit(step)).isin(parts))
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    size = rows.groupBy("label", "dim").agg(blocks(F.count_if("asked"), BLOCK).alias("n"), blocks(F.count("*"), 8 * BLOCK).alias("m"))
    rows = rows.join(size.where("n > 0"), ["label", "dim"])
    number = lambda n: F.pmod(F.xxhash64("c", F.lit(2)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.where("asked").withColumn("i", number("n")).withColumn("j", every("m"))
    others = rows.withColumn("asked", F.lit(False)).withColumn("j", number("m")).withColumn("i", every("n"))
    both = asked.unionByName(others).select(F.xxhash64("label", "dim", "i", "j").alias("g"), "c", "v", "component", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            first = table["asked"].to_numpy()
            a, b = table.filter(pa.array(first)), table.filter(pa.array(~first))
            if not (a.num_rows and b.num_rows):
                continue
            c, d = a["c"].to_numpy(), b["c"].to_numpy()
            i, j = np.nonzero((cosines(matrix(a["v"]), matrix(b["v"])) >= threshold) & (c[:, None] != d[None, :]))
            x, y = a["component"].to_numpy()[i], b["component"].to_numpy()[j]
            whole, times = np.unique(i[x == y], return_counts=True)
            lost = x != y
            _, one, more = np.unique(np.stack([i[lost], y[lost]]), axis=1, return_index=True, return_counts=True)
            u = np.concatenate([c[whole], c[i[lost][one]]])
            w = np.concatenate([np.zeros(len(whole), np.int64), d[j[lost][one]]])
            n = np.concatenate([times, more]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w, mask=np.arange(len(w)) < len(whole)), pa.array(n)], ["c", "w", "n"])

    return _together(both).mapInArrow(work, "c long, w long, n long")


def _counted(node: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """c, links: rows of other nodes of its component that each node links to, from all pairs, block by block."""
    size = found.groupBy("component").agg(F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("blocks"))
    rows = found.join(size, "component").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(node.select(F.col("c").alias("node"), "v", "m"), "node")
    rows = rows.select(F.col("node").alias("c"), "v", "m", "i", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    rows = rows.select("c", "v", "m", (F.col("i") <= F.col("j")).alias("first"), (F.col("i") >= F.col("j")).alias("second"), F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("g"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n, held = [], [], 0
        for table in groups(batches):
            a, b = (table.filter(table[k]) for k in ("first", "second"))
            alone = a.num_rows == table.num_rows and b.num_rows == table.num_rows
            x, y = matrix(a["v"]), matrix(b["v"])
            to, of = (t["m"].to_numpy().astype(float) for t in (a, b))
            back = np.zeros(b.num_rows)
            for lo in range(0, a.num_rows, BLOCK):
                strip = slice(lo, lo + BLOCK)
                hit = cosines((x[0][strip], x[1][strip]), y) >= threshold
                if alone:
                    row = np.arange(len(hit))
                    hit[row, lo + row] = False
                hit = hit.astype(float)
                n.append(hit @ of)
                back += to[strip] @ hit
            c.append(a["c"].to_numpy())
            if not alone:
                c.append(b["c"].to_numpy())
                n.append(back)
            held += table.num_rows
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (c, n)], ["c", "n"])
                c, n, held = [], [], 0
        if c:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (c, n)], ["c", "n"])

    return _together(rows).mapInArrow(work, "c long, n long").groupBy("c").agg(F.sum("n").alias("links"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, k: int = K, tables: int | None = None, rounds: int = ROUNDS, audit: int = AUDIT, aim: float = AIM, report: Callable[[dict], None] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector. `tables` None is for so many as MISS asks for, `audit` 0 for no audit;
    `report` gets each audit's attempt, nodes (compared), links (seen), lost (of them, those between components), recall."""
    node = written(nodes(embeddings), "nodes")
    sizes = node.groupBy("label").count().orderBy(F.desc("count")).limit(10_000).collect()
    width = lambda n: int(np.clip(np.ceil(np.log2(max(1, n / BUCKET))), 0, BITS))
    widths = {r["label"]: width(r["count"]) for r in sizes}
    usual = width(sizes[-1]["count"]) if sizes else 0  # of labels beyond the ten thousand largest
    total = node.count()

    def audited(attempt: int) -> tuple[list[DataFrame], float]:
        """The links that an audit adds, and the edge recall (1 where no links were seen)."""
        step, seen, links, lost, asked = max(audit, -(-total // AUDITED)), [], 0, 0, 0
        # Other nodes at each attempt: links of those before are known by now.
        own = [(attempt * FURTHER + part) % step for part in range(min(FURTHER, step))]
        for parts in (own[:1], own[1:]):
            table = written(_audited(node, found, step, parts, threshold), "audit")
            row = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("n"))), F.lit(0))).first()
            seen.append(table.where("w is not null").select(F.col("c").alias("a"), F.col("w").alias("b")))
            links, lost, asked = links + row[0], lost + row[1], asked + len(parts)
            if links >= ENOUGH or len(own) == 1:
                break
        told = {"attempt": attempt, "nodes": total * asked // step, "links": links, "lost": lost, "recall": 1 - lost / links if links else None}
        LOG.info("audit %s", told)
        if report:
            report(told)
        return seen if lost else [], 1 - lost / links if links else 1.0

    lists, more = None, []
    for attempt in range(4):
        floor = min(FLOOR, threshold) if attempt == 0 else -1.0
        fresh = _bucket_lists(_coded(node, 7 + attempt, widths, usual, threshold, tables and tables << attempt), k, floor)
        lists = written(_best(fresh if lists is None else fresh.union(lists), k, 2 * k, threshold), "lists")
        for r in range(1, rounds + 1):
            if lists.first() is None:  # no neighbours to follow
                break
            further = _descent(lists, node, k, k << r, floor)
            lists = written(_best(lists.union(further), k, k << (r + 1), threshold), "lists")
        links = lists.where(F.col("s") >= threshold).select(F.col("u").alias("a"), F.col("w").alias("b"))
        for table in more:  # what earlier audits have seen
            links = links.union(table)
        found, links = _joined(node, lists, links, k, threshold)
        if not audit:
            break
        added, recall = audited(attempt)
        more += added
        if recall >= aim:
            break
    else:
        if recall < LEAST_RECALL:
            raise RuntimeError(f"an edge recall of {recall:.3f} was measured; {LEAST_RECALL} is needed")
    if more:
        for table in more:
            links = links.union(table)
        found = written(components(links), "found")

    counted = _counted(node, found, threshold)
    label = node.select("c", "m", "least").join(found, F.col("c") == F.col("node"), "left").join(counted, "c", "left")
    label = label.select("c", "least", F.coalesce("component", "c").alias("component"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    label = label.join(smallest, "component").select("c", "n_links", "component_id")
    rows = columns(embeddings, "vec_id", "label", "embedding").select("vec_id", F.xxhash64("label", "embedding").alias("c"))
    out = rows.join(label, "c", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS r FROM e),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE a.r > 0 AND b.r > 0 AND list_inner_product(a.v, b.v) / (a.r * b.r) >= 0.98),
reach AS (
  WITH RECURSIVE t(a, b) AS (SELECT a, b FROM link UNION SELECT t.a, link.b FROM t JOIN link ON t.b = link.a)
  SELECT a, min(b) AS c FROM t GROUP BY a),
deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(coalesce(c, vec_id), vec_id) AS component_id, least(coalesce(c, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN deg ON deg.a = vec_id LEFT JOIN reach ON reach.a = vec_id
"""
