"""Token ids of whole texts, a block of texts at a time, with a bounded store of parts already seen.

The vocabulary's pattern always ends a piece before a space that follows or precedes something other than white space,
and between a letter and a mark other than an apostrophe. So texts may be cut there: the ids of a text are those of its
parts. Parts are told apart by two 64-bit hashes, looked up together, and only new ones reach the tokenizer, in one call.
A block in which one of the hashes agrees and the other doesn't goes to the tokenizer as it is.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tessitura.llm.shared import raw_text
from tessitura.llm.words import string_hashes

#: Parts kept in a worker, about 50 bytes each; at this number the store is emptied. Longer parts aren't kept.
STORED_PARTS, LONG_PART = 750_000, 64
VOCABULARY = "byte_bpe_50k"
_MARK = "<|endoftext|>"
_LOADED: dict[str, "Encoder"] = {}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True
_PUNCTUATION[39] = False
#: First bytes of characters that are surely not white space.
_SOLID = np.ones(256, bool)
_SOLID[:33] = _SOLID[127:195] = _SOLID[225:228] = False


class Encoder:
    """Ids as the `tokenizers` library gives them for `<name>.json` without added special tokens."""

    def __init__(self, name: str):
        self.name = name
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Bytes of text that each id stands for.
        self.widths = np.zeros(max(ranks.values()) + 2, np.int64)
        for piece, k in ranks.items():
            self.widths[k] = len(piece)
        self.widths[-1] = len(_MARK)
        self.marked: Tokenizer | None = None
        self._empty()

    def _empty(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def special(self, text: str) -> np.ndarray:
        """A text that holds the special token's string, by the library itself."""
        if self.marked is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.marked = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return np.array(self.marked.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, raw: bytes) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(raw.decode("utf-8", "replace")), np.uint32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each part): those that may follow any other together, the others one by one."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = data.tobytes()
        spaced = (data[starts] == 32) & (ends - starts > 1) & _SOLID[data[np.minimum(starts + 1, len(data) - 1)]]
        counts = np.zeros(len(starts), np.int64)
        pieces: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        if spaced.any():
            pairs = list(zip(starts[spaced].tolist(), ends[spaced].tolist(), strict=True))
            ids = self._plain(b"".join([raw[a:b] for a, b in pairs]))
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(ends[spaced] - starts[spaced])) + 1
            counts[spaced] = np.diff(cuts, prepend=0)
            pieces.append(ids)
        for k in np.flatnonzero(~spaced).tolist():
            pieces.append(self._plain(raw[starts[k] : ends[k]]))
            counts[k] = len(pieces[-1])
        sizes = counts[order]
        begin = np.empty(len(starts), np.int64)
        begin[order] = np.cumsum(sizes) - sizes
        return np.concatenate(pieces), np.stack([begin, counts])

    def _whole(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        each = [self._plain(raw[a:b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts `data[at[i]:at[i + 1]]`, one after another, and their offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 32) & _SOLID[data[1:]]
        cut[1:-1] |= _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
        cut[at] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        keys, one, which = np.unique(string_hashes(data, starts, ends), return_index=True, return_inverse=True)
        second = string_hashes(data, starts, ends, 1)
        checks = second[one]
        if (second != checks[which]).any():
            return self._whole(data, at)
        if len(self.keys) + len(keys) > STORED_PARTS:
            self._empty()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
            if (self.checks[place[known]] != checks[known]).any():
                return self._whole(data, at)
        fresh = one[~known]
        ids, table = self._learn(data, starts[fresh], ends[fresh])
        begin, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        begin[known], count[known] = self.start[place[known]], self.count[place[known]]
        pool = np.concatenate([self.pool, ids])
        if len(fresh):
            begin[~known], count[~known] = table[0] + len(self.pool), table[1]
            if (ends[fresh] - starts[fresh]).max() <= LONG_PART:
                spot = place[~known]
                self.keys = np.insert(self.keys, spot, keys[~known])
                self.checks = np.insert(self.checks, spot, checks[~known])
                self.start = np.insert(self.start, spot, begin[~known])
                self.count = np.insert(self.count, spot, count[~known])
                self.pool = pool
            else:
                short = np.flatnonzero(~known)[ends[fresh] - starts[fresh] <= LONG_PART]
                take = np.repeat(begin[short] - (np.cumsum(count[short]) - count[short]), count[short]) + np.arange(count[short].sum())
                self.keys = np.insert(self.keys, place[short], keys[short])
                self.checks = np.insert(self.checks, place[short], checks[short])
                self.start = np.insert(self.start, place[short], np.cumsum(count[short]) - count[short] + len(self.pool))
                self.count = np.insert(self.count, place[short], count[short])
                self.pool = np.concatenate([self.pool, pool[take]])
        begin, count = begin[which], count[which]
        total = np.concatenate([[0], np.cumsum(count)])
        out = pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, at)]


def encoder(name: str = VOCABULARY) -> Encoder:
    """One for each worker process."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(name)
    return _LOADED[name]


def encoded(texts: list[str | None], name: str = VOCABULARY) -> list[np.ndarray]:
    """Ids of each text; null counts as empty. Those that hold the special token's string go to the library."""
    data, at = raw_text(pa.array(texts, pa.string()))
    ids, to = encoder(name).encode(data, at)
    return [encoder(name).special(t) if t and _MARK in t else ids[to[k] : to[k + 1]] for k, t in enumerate(texts)]


def encoded_block(name: str, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of a block's texts."""
    ids, to = encoder(name).encode(data, at)
    raw = data.tobytes()
    if _MARK.encode() not in raw:
        return ids, to
    each = [encoder(name).special(t.decode()) if _MARK.encode() in (t := raw[at[k] : at[k + 1]]) else ids[to[k] : to[k + 1]] for k in range(len(at) - 1)]
    return np.concatenate(each), np.cumsum([0, *map(len, each)])
