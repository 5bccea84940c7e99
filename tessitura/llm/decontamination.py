"""Benchmark decontamination by a generalised suffix automaton.

The words of all test items go into one suffix automaton. Training words stream through it, and the length of the
longest match that ends at each word tells whether the last `window` words occur in an item. An item of fewer words is
one window. Only words of the items' vocabulary are looked at one by one: a run of such words that is shorter than the
shortest window can't hold a match.

Defined results: null and empty texts have no words; items without words are left out; repeated items and repeated
documents count as they stand (an item_id that occurs twice is one item, all items without id are one whose name is
empty); further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.shared import apart, columns, discard, text_blocks, written
from tessitura.llm.words import ALNUM, hashed_words

#: Words of items in one automaton, about; more items make more automata, so what is broadcast stays bounded.
BLOCK_WORDS = 100_000
#: Automata of one round, which the driver and each worker hold at once.
KEPT = 4


class SuffixAutomaton:
    """Of several word sequences. States are numbers; `edges` maps (state, word) to a state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        vocabulary = np.unique(np.array([w for _, ws in items for w in ws], np.uint64))
        self.vocabulary, self.size, self.window = vocabulary, max(1, len(vocabulary)), window
        self.length, self.link = [0], [-1]
        self.edges: dict[int, int] = {}
        self._out: list[list[int]] = [[]]
        coded = [(name, np.searchsorted(vocabulary, np.array(ws, np.uint64)).tolist()) for name, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.long: dict[int, set[str]] = {}
        short: dict[int, dict[str, int]] = {}
        for name, ws in coded:
            if len(ws) < window:
                state = 0
                for w in ws:
                    state = self.edges[state * self.size + w]
                short.setdefault(state, {})[name] = len(ws)
                continue
            for state, n in self.follow(ws):
                if n >= window:
                    self.long.setdefault(self.at_window(state), set()).add(name)
        self.shortest = min([window, *(len(ws) for _, ws in coded)])
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for state in sorted(range(len(self.length)), key=self.length.__getitem__):
                own = [(n, name) for name, n in short.get(state, {}).items()]
                above = self.short.get(self.link[state], []) if state else []
                if own or above:
                    self.short[state] = own + above
        del self._out

    def _new(self, length: int, link: int, copied: int = -1) -> int:
        state = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        if copied >= 0:
            for w in self._out[copied]:
                self.edges[state * self.size + w] = self.edges[copied * self.size + w]
            self._out[state] = list(self._out[copied])
        return state

    def _split(self, state: int, word: int) -> int:
        """The state of the longest string of `state`, plus `word`; split off where other strings share its state."""
        size, target = self.size, self.edges[state * self.size + word]
        if self.length[target] == self.length[state] + 1:
            return target
        fresh = self._new(self.length[state] + 1, self.link[target], target)
        self.link[target] = fresh
        while state >= 0 and self.edges.get(state * size + word) == target:
            self.edges[state * size + word] = fresh
            state = self.link[state]
        return fresh

    def _extend(self, last: int, word: int) -> int:
        size = self.size
        if last * size + word in self.edges:
            return self._split(last, word)
        state = self._new(self.length[last] + 1, 0)
        while last >= 0 and last * size + word not in self.edges:
            self.edges[last * size + word] = state
            self._out[last].append(word)
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, word)
        return state

    def at_window(self, state: int) -> int:
        """The state of the last `window` words of a match in `state`."""
        link, length, window = self.link, self.length, self.window
        while length[link[state]] >= window:
            state = link[state]
        return state

    def follow(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        edges, link, length, size = self.edges, self.link, self.length, self.size
        state, n = 0, 0
        for w in words:
            to = edges.get(state * size + w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = edges.get(state * size + w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            yield state, n

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each text with hits: the word spans of window occurrences (by their end), and the items."""
        if not len(self.vocabulary) or not len(hashes):
            return {}
        code = np.searchsorted(self.vocabulary, hashes)
        code[code == len(self.vocabulary)] = 0
        known = self.vocabulary[code] == hashes
        edge = np.zeros(len(hashes) + 1, bool)
        edge[first] = True
        prior = np.concatenate([[False], known[:-1]])
        after = np.concatenate([known[1:], [False]])
        starts = np.flatnonzero(known & (~prior | edge[:-1]))
        ends = np.flatnonzero(known & (~after | edge[1:])) + 1
        long = ends - starts >= self.shortest
        found: dict[int, tuple[list, set]] = {}
        window, runs = self.window, zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        for lo, hi in runs:
            own = None
            for k, (state, n) in enumerate(self.follow(code[lo:hi].tolist()), lo + 1):
                hit = []
                if n >= window:
                    hit.append((window, self.long[self.at_window(state)]))
                if self.short and state in self.short:
                    hit += [(m, (name,)) for m, name in self.short[state] if m <= n]
                for m, names in hit:
                    if own is None:
                        text = int(np.searchsorted(first, lo, "right")) - 1
                        own = found.setdefault(text, ([], set()))
                    own[0].append((k - m, k))
                    own[1].update(names)
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or adjoining spans joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def item_pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """name, words (hashes) of each item that has words. Items of more than `most` words are cut into pieces that overlap by
    `window` - 1 words, so every window is whole in a piece and no piece has less than one."""
    items = columns(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in text_blocks(batch.column(1)):
                hashes, _, _, first = hashed_words(data, at, ALNUM)
                rows, begins, ends = [], [], []
                for row, (begin, end) in enumerate(zip(first.tolist(), first[1:].tolist(), strict=False), lo):
                    last = end - window + 1 if end - begin > most else begin + (end > begin)
                    for k in range(begin, last, most - window + 1):
                        rows.append(row)
                        begins.append(k)
                        ends.append(min(end, k + most))
                words = [hashes[i:j].view(np.int64) for i, j in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.list_(pa.int64()))], ["name", "words"])

    return items.mapInArrow(work, "name string, words array<long>")


def automata(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, automaton (pickled): built by executors over hash blocks of pieces of items, each of about `block_words` words. The
    benchmark is read once, however many blocks there are."""
    pieces = written(item_pieces(benchmark, window, max(2 * window, block_words // 8)).distinct(), "items")
    blocks = max(1, -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))

    def build(table: pa.Table) -> pa.Table:
        names, words = table["name"].to_pylist(), table["words"].to_pylist()
        made = SuffixAutomaton([(name, np.array(ws, np.int64).view(np.uint64).tolist()) for name, ws in zip(names, words, strict=True)], window)
        return pa.table({"block": table["block"].slice(0, 1), "automaton": pa.array([pickle.dumps(made)], pa.binary())})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(blocks)))
    # As many partitions as blocks: these are small tables, which would otherwise be put together into a task or two.
    made = written(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(build, "block long, automaton binary"), "automata")
    discard(pieces)
    return made


def hits(held: list[Broadcast], texts: list[tuple[np.ndarray, np.ndarray]]) -> list[dict[int, tuple[list, set]]]:
    """What the automata find in each block of words."""
    found: list[dict[int, tuple[list, set]]] = [{} for _ in texts]
    for a in held:
        for out, block in zip(found, texts, strict=True):
            for text, (spans, items) in a.value.matches(*block).items():
                own = out.setdefault(text, ([], set()))
                own[0].extend(spans)
                own[1].update(items)
    return found


def less(raw: bytes, starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of merged spans and what stands between them."""
    parts, last = [], 0
    for lo, hi in spans:
        parts.append(raw[last : starts[lo]])
        last = int(ends[hi - 1])
    return b"".join([*parts, raw[last:]])


EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def marked(documents: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), max_coverage: float | None = None, block_words: int = BLOCK_WORDS, kept: int = KEPT) -> DataFrame:
    """The columns `keep` and n_words, n_hit, n_items, items_sha256, contaminated for each document.

    With `max_coverage` also `cleaned`: the text without its hit spans, or null where more than that share of the words
    is hit or nothing is left; a span's removal that makes a new window is followed by another removal.

    Up to `kept` automata stream through the documents together, in one pass without a shuffle. More go in rounds of `kept`, each
    of which is one pass whose hits are written; so neither the driver nor a worker ever holds more than a round's.
    """
    spark = documents.sparkSession
    made = automata(benchmark, window, block_words)
    blocks = [r["block"] for r in made.select("block").orderBy("block").collect()]
    names = list(dict.fromkeys([*keep, "text"]))
    source = columns(documents, *names)
    types = dict(source.dtypes)
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in keep), COUNTS, *(["cleaned string"] if max_coverage is not None else [])])

    def loaded(some: list[int]) -> list[Broadcast]:
        rows = made.where(F.col("block").isin(some)).collect() if some else []
        return [spark.sparkContext.broadcast(pickle.loads(r["automaton"])) for r in rows]

    rounds = [blocks[k : k + kept] for k in range(0, len(blocks), kept)]
    if len(rounds) > 1:
        return _in_rounds(source, rounds, loaded, keep, max_coverage, schema)
    held = loaded(blocks)
    discard(made)

    def clean(texts: dict[int, bytes]) -> dict[int, str]:
        """The texts without hit spans, until none is left."""
        out: dict[int, str] = {}
        while texts:
            places = {}
            for i, raw in texts.items():
                data = np.frombuffer(raw, np.uint8)
                places[i] = hashed_words(data, np.array([0, len(data)]), ALNUM)
            found = hits(held, [(h, first) for h, _, _, first in places.values()])
            left = {}
            for (i, raw), own in zip(texts.items(), found, strict=True):
                if not own:
                    out[i] = raw.decode("utf-8", "ignore")
                    continue
                left[i] = less(raw, *places[i][1:3], merged(own[0][0]))
            texts = left
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text"))
            n = batch.num_rows
            words, hit, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            digest = [EMPTY] * n
            texts = {}
            for lo, hi, data, at in text_blocks(text):
                hashes, _, _, first = hashed_words(data, at, ALNUM)
                words[lo:hi] = np.diff(first)
                for row, (spans, items) in hits(held, [(hashes, first)])[0].items():
                    i = lo + row
                    hit[i] = sum(e - s for s, e in merged(spans))
                    count[i] = len(items)
                    digest[i] = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                    if max_coverage is not None:
                        texts[i] = data[at[row] : at[row + 1]].tobytes() if hit[i] <= max_coverage * words[i] else b""
            out = [*(batch.column(names.index(k)) for k in keep), pa.array(words), pa.array(hit), pa.array(count), pa.array(digest, pa.string()), pa.array(hit > 0)]
            labels = [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if max_coverage is not None:
                if texts:
                    values = text.to_pylist()
                    for i, value in clean(texts).items():
                        values[i] = value if value.strip() else None
                    text = pa.array(values, pa.string())
                out.append(text)
                labels.append("cleaned")
            yield pa.RecordBatch.from_arrays(out, labels)

    return source.mapInArrow(work, schema)


def _in_rounds(source: DataFrame, rounds: list[list[int]], loaded: Callable[[list[int]], list[Broadcast]], keep: tuple[str, ...], max_coverage: float | None, schema: str) -> DataFrame:
    """`marked` for more automata than are held at once. Rows are numbered in a written table, which makes the numbers lasting;
    only texts with hits have rows in what a round finds, and only these are searched again after a cut."""
    rows = written(source.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def search(texts: DataFrame) -> DataFrame:
        """_row, spans (first word times 2^32, plus the word after the last), items of the texts (_row, text) with hits."""
        tables = []
        for some in rounds:
            held = loaded(some)

            def work(batches: Iterator[pa.RecordBatch], held: list[Broadcast] = held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lo, _, data, at in text_blocks(batch.column(1)):
                        hashes, _, _, first = hashed_words(data, at, ALNUM)
                        found = hits(held, [(hashes, first)])[0]
                        at_rows = pa.array([lo + row for row in found], pa.int64())
                        # Places are counted from the block's first word; what is kept counts from the text's.
                        spans = [[(a - int(first[row]) << 32) + b - int(first[row]) for a, b in merged(spans)] for row, (spans, _) in found.items()]
                        items = [sorted(items) for _, items in found.values()]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at_rows), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["_row", "spans", "items"])

            tables.append(written(texts.select("_row", "text").mapInArrow(work, "_row long, spans array<long>, items array<string>"), "hits"))
            for b in held:
                b.destroy()
        both = tables[0]
        for t in tables[1:]:
            both = both.union(t)
        out = written(both.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "found")
        for t in tables:
            discard(t)
        return out

    def spans_of(values: list[int] | None) -> list[tuple[int, int]]:
        return merged([(v >> 32, v & 0xFFFFFFFF) for v in values or []])

    def cut(texts: DataFrame, coverage: float | None = None) -> DataFrame:
        """(_row, text, spans) as _row and the text without its spans, empty where more than `coverage` of its words is hit."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw, spans = text.encode(), spans_of(values)
                    hashes, starts, ends, _ = hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
                    over = coverage is not None and sum(b - a for a, b in spans) > coverage * len(hashes)
                    out.append("" if over else less(raw, starts, ends, spans).decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "text"])

        return written(texts.mapInArrow(work, "_row long, text string"), "cut")

    found = search(rows)
    joined = rows.join(found, "_row", "left")
    if max_coverage is not None:
        texts = cut(rows.select("_row", "text").join(found.select("_row", "spans"), "_row"), max_coverage)
        done = None
        while texts.first() is not None:
            more = search(texts)
            clear = texts.join(more, "_row", "left_anti")
            done = clear if done is None else done.union(clear)
            texts = cut(texts.join(more.select("_row", "spans"), "_row"))
        done = texts if done is None else done
        joined = joined.join(done.withColumnRenamed("text", "cleaned"), "_row", "left")
    columns_in = joined.columns

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(columns_in.index("text"))
            words = np.zeros(batch.num_rows, np.int64)
            for lo, hi, data, at in text_blocks(text):
                words[lo:hi] = np.diff(hashed_words(data, at, ALNUM)[3])
            hit = np.array([sum(b - a for a, b in spans_of(v)) for v in batch.column(columns_in.index("spans")).to_pylist()], np.int64)
            items = batch.column(columns_in.index("items")).to_pylist()
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else EMPTY for x in items]
            out = [*(batch.column(columns_in.index(k)) for k in keep), pa.array(words), pa.array(hit), pa.array([len(x or ()) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(hit > 0)]
            labels = [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if max_coverage is not None:
                cleaned = zip(hit.tolist(), text.to_pylist(), batch.column(columns_in.index("cleaned")).to_pylist(), strict=True)
                out.append(pa.array([t if not n else c if c and c.strip() else None for n, t, c in cleaned], pa.string()))
                labels.append("cleaned")
            yield pa.RecordBatch.from_arrays(out, labels)

    return joined.mapInArrow(tally, schema)


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """The documents without benchmark passages: hit spans are cut out, and a document goes if more than
    `max_coverage` of its words are hit or nothing is left. Documents without hits stay as they are, null texts too."""
    source, back = apart(documents, "doc_id", "text", "n_chars")
    cut = marked(source, benchmark, window, tuple(source.columns), max_coverage)
    kept = cut.where(~F.col("contaminated") | F.col("cleaned").isNotNull())
    if "n_chars" in documents.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("contaminated"), F.length("cleaned").cast(dict(documents.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return back(kept.withColumn("text", F.when(F.col("contaminated"), F.col("cleaned")).otherwise(F.col("text"))))


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return marked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
