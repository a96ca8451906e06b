"""Batch encoder for a lower-casing word BPE vocabulary file.

The ids are those of the ``tokenizers`` library for the same file; the work is done
for all distinct words of a batch at once: each round of merges is a handful of
array operations over every word that still has a mergeable pair. Texts outside
the Latin ranges, texts with the string of a special token, and words beyond
``MATRIX_BYTES`` go to the library itself. What such a string means is a parameter:
the token, as the library does by default, or ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

#: Code points below U+0180 (without U+0130, whose lower case is two code points)
#: are single, composed and lower-case one to one, so no normalisation is needed.
_FAST = re.compile("[\x00-įı-ſ]*")
#: The file's own word pattern, written out for those code points.
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")
MATRIX_BYTES = 96
CACHE_WORDS = 200_000
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    known = {b: chr(b) for b in plain}
    for extra, b in enumerate(x for x in range(256) if x not in known):
        known[b] = chr(256 + extra)
    return [known[b] for b in range(256)]


class PairTable:
    """Open-addressing table from a pair of symbols to the rank of its merge."""

    BITS = 18

    def __init__(self, left: np.ndarray, right: np.ndarray):
        size = 1 << self.BITS
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int32)
        keys = (left.astype(np.int64) << 20) | right
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[slot[put]], self.rank[slot[put]] = keys[put], put
            todo = todo[~(free & first)]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        out = np.full(keys.shape, _NONE, np.int32)
        flat, res = keys.ravel(), out.ravel()
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(flat[todo])
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == flat[todo]
            res[todo[hit]] = self.rank[slot[hit]]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            todo, slot = todo[more], (slot[more] + 1) & (len(self.keys) - 1)
        return res.reshape(out.shape)


class _Codes(dict):
    """Words in the order they were met, each with its number; a new word gets the next."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordBpe:
    """Encoder with a bounded cache of words."""

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        names = [re.escape(t["content"]) for t in file.get("added_tokens", []) if special or not t.get("special")]
        self.added = re.compile("|".join(names) or "(?!)", re.I)
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int32) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank = PairTable(left, right)
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.learnt = 0
        self.flat = np.empty(0, np.int32)
        self.starts, self.lens = np.empty(0, np.int64), np.empty(0, np.int64)

    def _matrix(self, words: list[bytes], sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of words of similar length, all merged in step: (which words, a row of ids each, -1 beyond) by number of rounds."""
        n, width = len(words), int(sizes.max())
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        sym = self.inner[raw]
        cols = np.arange(width)
        sym[cols[None, :] >= sizes[:, None]] = -1
        sym[np.arange(n), sizes - 1] = self.final[raw[np.arange(n), sizes - 1]]
        done: list = []
        who = np.arange(n)
        if width == 1:
            return [(who, sym)]
        ranks = self.rank(sym[:, :-1], sym[:, 1:])
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            live = best != _NONE
            if not live.all():
                done.append((who[~live], sym[~live]))
                who, sym, ranks, at, best = who[live], sym[live], ranks[live], at[live], best[live]
            if not len(who):
                return done
            rows, width = np.arange(len(who)), sym.shape[1]
            take = np.arange(width - 1)[None, :]
            new = np.take_along_axis(sym, take + (take > at[:, None]), 1)
            new[rows, at] = self.merged[best]
            if width == 2:
                return [*done, (who, new)]
            take = np.arange(width - 2)[None, :]
            ranks = np.take_along_axis(ranks, take + (take >= at[:, None]), 1)
            for shift in (-1, 0):
                ok = np.flatnonzero((at + shift >= 0) & (at + shift < width - 2))
                col = at[ok] + shift
                ranks[ok, col] = self.rank(new[ok, col], new[ok, col + 1])
            sym = new

    def _learn(self) -> None:
        """Add the ids of words that have a code but no ids yet."""
        words = list(islice(self.codes, self.learnt, None))
        self.learnt += len(words)
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(sizes, kind="stable")
        lens, starts, parts, used, start = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), [self.flat], len(self.flat), 0
        by_size = sizes[order]
        while start < len(order):
            size = int(by_size[start])
            if size > MATRIX_BYTES:
                found = [(order[k : k + 1], np.array([self.library.encode(words[order[k]], add_special_tokens=False).ids], np.int32)) for k in range(start, len(order))]
                start = len(order)
            else:
                stop = min(int(np.searchsorted(by_size, size + max(1, size // 8), "right")), start + 20_000)
                which = order[start:stop]
                found = [(which[who], ids) for who, ids in self._matrix([raw[k] for k in which], sizes[which])]
                start = stop
            for which, ids in found:
                real = ids >= 0
                n = real.sum(1)
                lens[which], starts[which] = n, used + np.cumsum(n) - n
                parts.append(ids[real])
                used += len(parts[-1])
        self.flat = np.concatenate(parts)
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text, with ``end_id`` after them if given."""
        if len(self.codes) > CACHE_WORDS:
            self._forget()
        code, tail = self.codes.__getitem__, [] if end_id is None else [end_id]
        coded, sizes, plain = [], [], []
        for text in texts:
            plain.append(_FAST.fullmatch(text) is not None and not self.added.search(text))
            words = _WORD.findall(text.lower()) if plain[-1] else []
            coded.extend(map(code, words))
            sizes.append(len(words))
        if len(self.codes) > self.learnt:
            self._learn()
        codes = np.array(coded, np.int64)
        lens = self.lens[codes]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[codes] - ends[:-1], lens)]
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        out = []
        for k, text in enumerate(texts):
            own = ids[bounds[k] : bounds[k + 1]] if plain[k] else np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            out.append(np.append(own, np.array(tail, np.int32)))
        return out


_LOADED: dict[tuple[str, bool], WordBpe] = {}


def loaded(path: str, special: bool = True) -> WordBpe:
    """One encoder per worker process, file and meaning of special tokens' strings."""
    if (path, special) not in _LOADED:
        _LOADED[path, special] = WordBpe(path, special)
    return _LOADED[path, special]
