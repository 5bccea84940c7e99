"""Token counts of sections, from one encoding of the whole text.

A text is encoded once; the ids' byte widths give each token's span, and an interval join by binary search finds the
sections it touches. A token within one section counts there. One that crosses a boundary counts, by `rule`:

- "most": in the section that holds most of its bytes, of equal ones the earliest;
- "start": in the section that holds its first byte in any section.

Sections are a document's lines (each with its line end), or given as (doc_id, section, start, end) in code points, ends
exclusive; those of a document may leave gaps but must not overlap. Tokens outside all sections count in section null.

Defined results: null and empty texts have one empty line; repeated rows are documents of their own; documents without
given sections have only section null; sections of unknown documents are left out; spans are cut to the text; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.line_quality import lines
from tessitura.llm.shared import columns, digits, text_blocks
from tessitura.llm.tokens import VOCABULARY, encoded_block, encoder

RULES = ("most", "start")


def attributed(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether it crosses a boundary). Tokens [starts, ends) and sections [a, b) ascend and
    don't overlap; a section may be empty, and then holds no token."""
    some = np.flatnonzero(b > a)
    if not len(some) or not len(starts):
        return np.full(len(starts), -1, np.int64), np.zeros(len(starts), bool)
    a, b = a[some], b[some]
    low = np.searchsorted(b, starts, "right")  # the first section that ends after the token's start
    high = np.searchsorted(a, ends, "left") - 1  # the last one that starts before its end
    out = np.where(low <= high, low, -1)
    at = np.minimum(low, len(a) - 1)
    crossing = (out >= 0) & ((low < high) | (starts < a[at]) | (ends > b[at]))
    if rule == "most":
        several = np.flatnonzero(low < high)
        count = high[several] - low[several] + 1
        token, section = np.repeat(several, count), np.repeat(low[several], count) + digits(count)
        held = np.minimum(ends[token], b[section]) - np.maximum(starts[token], a[section])
        order = np.lexsort((section, -held, token))
        first = np.ones(len(order), bool)
        first[1:] = token[order][1:] != token[order][:-1]
        out[token[order][first]] = section[order][first]
    return np.where(out >= 0, some[np.maximum(out, 0)], -1), crossing


def section_tokens(documents: DataFrame, sections: DataFrame | None = None, rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section, start, end (code points), n_tokens, n_crossing (of them, those that cross a boundary)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = columns(documents, "doc_id", "text")
    kind = dict(source.dtypes)["doc_id"]
    given = sections is not None
    if given:
        spans = columns(sections, "doc_id", "section", "start", "end").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("section").cast("long").alias("section")))).alias("spans"))
        source = source.join(spans, "doc_id", "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in text_blocks(batch.column(1), 1 << 20):
                ids, to = encoded_block(vocabulary, data, at)
                width = encoder(vocabulary).widths[ids]
                ends = np.cumsum(width)
                starts = ends - width
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                if not given:
                    a, b, first = lines(data, at)
                    b = b + 1
                    b[first[1:] - 1] -= 1
                    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
                    name = digits(np.diff(first))
                else:
                    a, b, name, text = [], [], [], []
                    place = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))  # the byte of each character
                    for k in range(len(at) - 1):
                        own, base, most = batch.column(2)[lo + k].as_py() or [], chars[at[k]], chars[at[k + 1]]
                        for x in own:
                            a.append(place[min(max(base + x["start"], base), most)])
                            b.append(max(a[-1], place[min(max(base + x["end"], base), most)]))
                            name.append(x["section"])
                            text.append(k)
                    a, b, name, text = (np.array(x, np.int64) for x in (a, b, name, text))
                section, crossing = attributed(starts, ends, a, b, rule)
                n = np.bincount(section[section >= 0], minlength=len(a))
                c = np.bincount(section[crossing], minlength=len(a))
                rows, names, begin, end = text + lo, list(name), chars[a] - chars[at[text]], chars[b] - chars[at[text]]
                outside = np.bincount(np.searchsorted(to, np.flatnonzero(section < 0), "right") - 1, minlength=len(at) - 1)
                rest = np.flatnonzero(outside)
                out = [batch.column(0).take(pa.array(np.concatenate([rows, rest + lo]))), pa.array([*names, *[None] * len(rest)], pa.int64())]
                out += [pa.array(np.concatenate([x, np.zeros(len(rest), np.int64)]), mask=np.concatenate([np.zeros(len(x), bool), np.ones(len(rest), bool)])) for x in (begin, end)]
                out += [pa.array(np.concatenate([n, outside[rest]]).astype(np.int64)), pa.array(np.concatenate([c, 0 * rest]).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return source.mapInArrow(work, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
