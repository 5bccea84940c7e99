"""Secrets in whole texts: three patterns, and values in credential contexts that are costly to guess.

A value that follows a credential word is cut into words, dates, repeats, keyboard walks, sequences and brute-force spans.
Words are common ones of passwords, and those that stand whole in a public tokenizer's vocabulary, which is in order of
frequency: tens of thousands, so ordinary prose after "the password is" is cheap to guess.
Dynamic programming finds the cheapest cut, in decimal digits of guesses; values of at least `MIN_GUESSES` digits are
secrets of kind `guess`. Values of any length are taken whole: the work is linear in their length.

Guesses alone don't tell a secret from a rare word, so before its cost counts, a value is read as text: of an address
(scheme://...) each part is judged alone; and a value of fewer than `PHRASE` words, cut at punctuation and where small letters
meet capitals, is prose, as is one that names itself a placeholder. A part is a word if it is in the vocabulary, or if its
letters follow each other about as in the vocabulary's words (a chain of letter pairs, in digits a letter) and it has fewer
than `LONG_WORD` of them; digits make no word.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are scanned
each; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tessitura.llm.shared import columns, text_blocks
from tessitura.llm.tokens import VOCABULARY
from tessitura.llm.words import LOWER

#: Decimal digits of guesses from which a value counts as a secret, and its least length.
MIN_GUESSES, MIN_VALUE = 9.0, 6
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A credential word, what leads to its value, and the value up to white space, quotes or list marks.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api_?key|credentials?)["']?(?:\x20*[:=]\x20*|\x20+(?:is|was)\x20+)["']?([^\s"'<>,;|]+)""", re.ASCII | re.IGNORECASE)
_WORD = re.compile(rb"pass(?:word|wd|phrase|code)|pwd|secret|token|api_?key|credential")
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True

#: From so many words on a value is a passphrase; from so many letters on, a part that isn't in the vocabulary is no word; and the
#: most digits of guesses a letter that a word's letters take.
PHRASE, LONG_WORD, LETTER = 4, 16, 1.35
#: Words by which a value says that it stands for another.
PLACEHOLDERS = frozenset("your example sample dummy placeholder changeme insert replace here redacted hidden todo none null".split())
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
_PARTS = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Common words of passwords, commonest first.
COMMON = (
    "password admin welcome login qwerty letmein monkey dragon master sunshine princess football baseball shadow superman "
    "michael jordan secret test guest root user default changeme temp hello love money summer winter spring autumn january "
    "february march april may june july august september october november december monday tuesday wednesday thursday friday "
    "saturday sunday happy freedom whatever trustno computer internet server system office company service manager access "
    "public private example sample dummy placeholder none null true false your insert replace here value token key api pass "
    "word database oracle mysql postgres redis azure amazon google apple microsoft windows linux ubuntu docker cloud staging "
    "production development debug black white red blue green yellow orange purple silver gold tiger lion eagle wolf bear cat "
    "dog horse fish bird star moon sun earth water fire the and that this with from have are was for not you all any can her"
).split()
_LEET = str.maketrans("013457@$!", "oleastasi")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_DATES = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)?\d\d|(?:19|20)\d\d")
#: Digits of guesses for each further segment: which kind comes next.
SEGMENT = log10(5)
_REPEATED = 8


@cache
def _ranks(vocabulary: str) -> dict[str, float]:
    """Digits of guesses of each word, by its rank."""
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines]
    more = [p[1:].decode().lower() for p in pieces if len(p) > 3 and p[:1] == b" " and p[1:].isalpha()]
    return {w: log10(k + 2) for k, w in reversed(list(enumerate([*COMMON, *more])))}


@cache
def _longest(vocabulary: str) -> int:
    return max(map(len, _ranks(vocabulary)))


@cache
def _pairs(vocabulary: str) -> dict[str, float]:
    """Digits of guesses of a letter after another (a space before the first), from the vocabulary's words."""
    counts: dict[str, int] = {}
    for word in _ranks(vocabulary):
        for pair in zip(" " + word, word, strict=False):
            for key in ("".join(pair), pair[0]):
                counts[key] = counts.get(key, 0) + 1
    return {key: log10((counts[key[0]] + 26) / (n + 1)) for key, n in counts.items() if len(key) == 2}


def is_word(part: str, vocabulary: str = VOCABULARY) -> bool:
    """Whether letters are a word of the vocabulary, or could be one."""
    low = part.lower()
    if low in _ranks(vocabulary):
        return True
    pairs = _pairs(vocabulary)
    return 3 <= len(low) < LONG_WORD and sum(pairs.get(a + b, 2.5) for a, b in zip(" " + low, low, strict=False)) <= LETTER * len(low)


def is_prose(value: str, vocabulary: str = VOCABULARY) -> bool:
    """Whether a value is fewer words than a passphrase, or a placeholder."""
    parts = [x for part in _PARTS.findall(value) for x in _CAMEL.split(part)]
    if not parts or not all(x.isalpha() and (len(x) < 3 or is_word(x, vocabulary)) for x in parts):
        return False
    short = sum(len(x) < 3 for x in parts)
    return short * 2 <= len(parts) and (len(parts) - short < PHRASE or any(x.lower() in PLACEHOLDERS for x in parts))


def value_cost(value: str, vocabulary: str = VOCABULARY) -> float:
    """The digits of guesses of a value; 0 where it is prose. An address counts as its costliest part."""
    if _ADDRESS.match(value):
        return max((value_cost(x, vocabulary) for x in re.split(r"[/?&=#:@.]+", value) if len(x) >= MIN_VALUE), default=0.0)
    return 0.0 if is_prose(value, vocabulary) else guess_cost(value, vocabulary=vocabulary)[0]


@cache
def _keys() -> dict[str, tuple[float, int]]:
    """Where keys lie; each row is half a key to the right of the one above."""
    return {c: (x + y / 2, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def _way(a: str, b: str) -> tuple[float, int] | None:
    """The direction from a key to one beside it, None for others."""
    at = _keys()
    if a == b or a not in at or b not in at:
        return None
    dx, dy = at[b][0] - at[a][0], at[b][1] - at[a][1]
    return (dx, dy) if abs(dx) <= 1 and abs(dy) <= 1 else None


def _brute(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return log10(26)
    return log10(33) if c < "\x80" else 2.0


def _word_cost(text: str, base: float) -> float:
    upper = sum(c.isupper() for c in text)
    cost = base
    if upper:
        cost += log10(2) if upper == len(text) or upper == 1 and text[0].isupper() else log10(2) * min(upper, len(text) - upper) + log10(2)
    return cost + log10(2) * sum(c in "013457@$!" for c in text)


def segments(value: str, nested: bool = False, vocabulary: str = VOCABULARY) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, digits of guesses) of the parts that are cheaper than brute force, in order of start."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain, ranks, longest = low.translate(_LEET), _ranks(vocabulary), _longest(vocabulary)
    keys = low.translate(_SHIFTED)
    repeat_end = [0] * (_REPEATED + 1)
    walk_end = run_end = 0
    for i in range(n):
        for size in range(3, min(longest, n - i) + 1):
            for form in {low[i : i + size], plain[i : i + size]}:
                if form in ranks:
                    yield i, i + size, "word", _word_cost(value[i : i + size], ranks[form])
        if low[i].isascii() and low[i].isdigit() and (m := _DATES.match(value, i)):
            digits = m.end() - i
            yield i, m.end(), "date", 2.1 if digits == 4 else 4.6 + 0.6 * (digits > 8)
        if i >= walk_end - 2:
            k, turns, before = i, 0, None
            while k + 1 < n and (way := _way(keys[k], keys[k + 1])):
                turns, before = turns + (way != before), way
                k += 1
            if k - i >= 2:
                walk_end = k + 1
                yield i, k + 1, "walk", log10(47) + log10(max(2, k + 1 - i)) + 0.45 * turns
        if i >= run_end - 1 and i + 2 < n and (step := ord(value[i + 1]) - ord(value[i])) in (1, -1):
            k = i + 1
            while k + 1 < n and ord(value[k + 1]) - ord(value[k]) == step:
                k += 1
            if k - i >= 2:
                run_end = k + 1
                yield i, k + 1, "sequence", log10(26) + log10(k + 1 - i)
        if nested:
            continue
        for unit in range(1, min(_REPEATED, (n - i) // 2) + 1):
            if i < repeat_end[unit] - unit:
                continue
            k = i + unit
            while k < n and value[k] == value[k - unit]:
                k += 1
            count = (k - i) // unit
            if count >= 2 and count * unit >= 3:
                repeat_end[unit] = k
                yield i, i + count * unit, "repeat", guess_cost(value[i : i + unit], True, vocabulary)[0] + log10(count)


def guess_cost(value: str, nested: bool = False, vocabulary: str = VOCABULARY) -> tuple[float, list[tuple[int, int, str]]]:
    """The fewest digits of guesses over all cuts of the value, and the cut."""
    n = len(value)
    if n == 0:
        return 0.0, []
    best, last = [0.0] + [float("inf")] * n, [(0, "")] * (n + 1)
    brute, begun = [float("inf")] * (n + 1), [0] * (n + 1)  # with a brute-force span that ends here
    parts = segments(value, nested, vocabulary)
    following = next(parts, None)
    for i in range(n + 1):
        if brute[i] < best[i]:
            best[i], last[i] = brute[i], (begun[i], "brute")
        if i == n:
            break
        while following and following[0] == i:
            _, end, kind, cost = following
            cost += best[i] + SEGMENT
            if cost < best[end]:
                best[end], last[end] = cost, (i, kind)
            following = next(parts, None)
        step = _brute(value[i])
        brute[i + 1], begun[i + 1] = (brute[i] + step, begun[i]) if brute[i] <= best[i] + SEGMENT else (best[i] + SEGMENT + step, i)
    cut, k = [], n
    while k:
        start, kind = last[k]
        cut.append((start, k, kind))
        k = start
    return best[n], cut[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def guessed_spans(text: str, least: float = MIN_GUESSES, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, digits of guesses) of costly values in credential contexts."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?)]}")
        if len(value) >= MIN_VALUE and (cost := value_cost(value, vocabulary)) >= least:
            out.append((m.start(1), 3, m.start(1) + len(value), cost))
    return out


def _candidates(data: np.ndarray, at: np.ndarray) -> list[int]:
    """Texts of a block that may hold a span: those with a credential word, an access mark or a long hex run."""
    places = [m.start() for m in _WORD.finditer(LOWER[data].tobytes())]
    raw, k = data.tobytes(), -1
    while (k := raw.find(b"AKIA", k + 1)) >= 0:
        places.append(k)
    change = np.flatnonzero(np.diff(_HEX[data], prepend=False, append=False))
    starts, ends = change[::2], change[1::2]
    places += starts[ends - starts >= 24].tolist()
    # A run over the end of a text may begin in one and be long in the next.
    places += (ends[ends - starts >= 24] - 1).tolist()
    inner = at[1:-1]
    cut = inner[_HEX[data[np.maximum(inner - 1, 0)]] & _HEX[data[np.minimum(inner, max(len(data) - 1, 0))]]] if len(data) else inner[:0]
    touched = set((np.searchsorted(at, np.array(places, np.int64), "right") - 1).tolist())
    near = np.searchsorted(at, cut, "right") - 1
    return sorted(touched | set(near.tolist()) | set((near - 1).tolist()))


def secrets(documents: DataFrame, least: float = MIN_GUESSES, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, guess_digits (the most of a value, or null)."""
    source = columns(documents, "doc_id", "text")
    empty = hashlib.sha256(b"").hexdigest()

    def told(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((n, 4), np.int64)
            digest, spans, most = [empty] * n, [""] * n, [None] * n
            for lo, _, data, at in text_blocks(batch.column(1)):
                for row in _candidates(data, at):
                    text = data[at[row] : at[row + 1]].tobytes().decode("utf-8", "replace")
                    base, more = base_spans(text), guessed_spans(text, least, vocabulary)
                    i = lo + row
                    for _, k, *_ in [*base, *more]:
                        counts[i, k] += 1
                    digest[i] = hashlib.sha256(told(base).encode()).hexdigest()
                    spans[i] = told(base + [x[:3] for x in more])
                    most[i] = max((round(x[3], 3) for x in more), default=None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(most, pa.float64())], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "guess_digits"])

    return source.mapInArrow(work, f"doc_id {dict(source.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, guess_digits double")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
