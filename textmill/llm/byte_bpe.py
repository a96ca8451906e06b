"""Operator 6: byte-level BPE as a lazily determinised finite-state transducer.

The merge ranks are compiled into a transducer over bytes. While it reads, a state
holds every start from which a token may still be in progress: the trie node reached
from there and the tokens chosen up to there since the last output. A start's tokens
are unique, because two tokens may be neighbours only if merging their joint bytes
gives just these two. Tokens on which all live starts agree are output at once, so
output lags by less than the longest token (bounded lookahead). States and moves are
made when first met and kept; ``MAX_STATES`` bounds the table, which is then begun anew.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8 machine
that holds back an unfinished character at the end of a chunk.

Defined results: a null or empty text has no ids and decodes to nothing; strings of
special tokens are ordinary text; repeated rows are encoded once each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_slices, texts_of

MAX_STATES = 400_000
MAX_PIECES = 300_000
_START, _ANY = -1, -2

#: The white space of the rank files' pattern, and its classes below U+0180.
_SPACE = "\t-\r \x85\xa0  -     　"
_LOW = {
    r"\p{L}": "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ",
    r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe",
    r"\s": "\t-\r \x85\xa0",
}


def _piece_patterns(pattern: str):
    """The splitting pattern for all texts, and a plainer equal one for texts below U+0180."""
    low = pattern.replace(r"(?!\S)", f"(?![^{_LOW[chr(92) + 's']}])")
    inside = low.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(_LOW[k] for k in (chr(92) + 's', chr(92) + 'p{L}', chr(92) + 'p{N}'))}]")
    for name, chars in _LOW.items():
        inside = inside.replace(name, f"[{chars}]")
    full = pattern.replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]")
    return regex.compile(full), re.compile(inside)


class Transducer:
    """Encoder of single pieces, by the merge ranks alone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        # trie: child of (node, byte), token that ends at a node, whether a node has children
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for word, rank in ranks.items():
            at = 0
            for b in word:
                nxt = self.child[at].get(b)
                if nxt is None:
                    nxt = len(self.child)
                    self.child[at][b] = nxt
                    self.child.append({})
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.rest: list[tuple] = []
        self._state((_START, ((0, ()),)))

    def _state(self, content: tuple) -> int:
        k = self.states.get(content)
        if k is None:
            k = self.states[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
            self.rest.append(content[1][-1][1])
        return k

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte, and for what merging never makes."""
        if token not in self.made_of:
            piece = self.token[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                ranked = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.made_of[token]

    def _side(self, token: int, half: int) -> list[tuple[int, float]]:
        """What stands next to the boundary while ``token`` is merged: each part and the rank of the merge that ends it."""
        side, until = [], math.inf
        while True:
            side.append((token, until))
            parts = self.halves(token)
            if parts is None:
                return side[::-1]
            until, token = token, parts[half]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (``_START``: begin a piece): no merge ever crosses their boundary."""
        known = self.pairs.get((left, right))
        if known is None:
            if left == _START:
                known = len(self.token[right]) == 1 or self.halves(right) is not None
            else:
                known = self._apart(self._side(left, 1), self._side(right, 0))
            if len(self.pairs) > 2 * MAX_STATES:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _apart(self, before: list, after: list) -> bool:
        """Follow both sides in time. A crossing merge comes first if its rank is below that of the
        merge on the left, and not above that of the merge on the right (of equals the left one is first)."""
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = before[i], after[j]
            rank = self.ranks.get(self.token[a] + self.token[b])
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if a_until == b_until == math.inf:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        context, starts = self.content[state]
        live, here = [], None
        for node, path in starts:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            token = self.ends[nxt]
            if here is None and token >= 0 and self.neighbours(path[-1] if path else context, token):
                here = (*path, token)
            if self.child[nxt]:
                live.append((nxt, path))
        live.append((0, here))
        agreed, paths = 0, [p for _, p in live]
        shortest = min(map(len, paths))
        while agreed < shortest and all(p[agreed] == here[agreed] for p in paths):
            agreed += 1
        if agreed:
            context = here[agreed - 1]
            live = [(node, path[agreed:]) for node, path in live]
        if all(path for _, path in live):
            context = _ANY
        move = self.moves[state][byte] = (self._state((context, tuple(live))), here[:agreed])
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.content) > MAX_STATES:
            self._reset()
        state, out = 0, []
        for byte in piece:
            state, ready = self.moves[state].get(byte) or self._move(state, byte)
            if ready:
                out.extend(ready)
        out.extend(self.rest[state])
        return out


def _utf8_moves() -> list[dict[int, int]]:
    """Moves of the UTF-8 machine, by state and byte; a byte without a move ends in an error.

    State 0 is between characters, 1 to 3 wait for that many bytes of any kind, the others
    for a second byte whose range the first one narrows (no overlong form, no surrogate,
    nothing beyond U+10FFFF).
    """
    more = range(0x80, 0xC0)
    narrow = {0xE0: (range(0xA0, 0xC0), 1), 0xED: (range(0x80, 0xA0), 1), 0xF0: (range(0x90, 0xC0), 2), 0xF4: (range(0x80, 0x90), 2)}
    moves: list[dict[int, int]] = [dict.fromkeys(range(0x80), 0) | dict.fromkeys(range(0xC2, 0xE0), 1) | dict.fromkeys(range(0xE1, 0xF0), 2) | dict.fromkeys(range(0xF1, 0xF4), 3)]
    moves += [dict.fromkeys(more, 0), dict.fromkeys(more, 1), dict.fromkeys(more, 2)]
    for first, (second, then) in narrow.items():
        moves[0][first] = len(moves)
        moves.append(dict.fromkeys(second, then))
    return moves


class Utf8Machine:
    """Incremental decoding: the bytes of a character that isn't over wait for the next ones.

    The machine's state at the end of a chunk follows from its last bytes, from the last
    one that can begin a character on; all before is decoded at once.
    """

    MOVES = _utf8_moves()

    def __init__(self):
        self.held = b""

    def waiting(self, data: bytes) -> int:
        """Bytes at the end that bring the machine into a state that waits for more."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] < 0x80 or data[-back] > 0xBF:
                state: int | None = 0
                for byte in data[-back:]:
                    state = self.MOVES[state].get(byte)
                    if state is None:
                        return 0
                return back if state else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        k = self.waiting(data)
        data, self.held = (data[:-k], data[-k:]) if k else (data, b"")
        return data.decode("utf-8", errors="replace")

    def finish(self) -> str:
        data, self.held = self.held, b""
        return data.decode("utf-8", errors="replace")


class ByteBpe:
    """Encoder and decoder of texts for one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(self.ranks)
        self.bytes_of = [self.transducer.token.get(i, b"") for i in range(max(self.transducer.token) + 1)]
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.full, self.low = _piece_patterns(pattern)
        self.latin = re.compile("[\x00-ſ]*")
        self.pieces: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        known = self.pieces
        if len(known) > MAX_PIECES:
            known.clear()
        pattern = self.low if self.latin.fullmatch(text) else self.full
        pieces = pattern.findall(text)
        try:
            return list(chain.from_iterable(map(known.__getitem__, pieces)))
        except KeyError:
            for p in set(pieces).difference(known):
                known[p] = tuple(self.transducer.encode(p.encode()))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: Iterable[int], chunk: int = 1 << 16) -> Iterator[str]:
        """Texts of successive chunks of ids; together the whole text."""
        machine, ids = Utf8Machine(), list(ids)
        for k in range(0, len(ids), chunk):
            yield machine.feed(b"".join(map(self.bytes_of.__getitem__, ids[k : k + chunk])))
        yield machine.finish()


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path, pattern)
        ids = [bpe.encode(t) for t in texts_of(part)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` of ids as made by :func:`encode`."""

    def run(batches):
        bpe = loaded(path, pattern)
        for part in batches:
            texts = ["".join(bpe.decode(ids.as_py() or [])) for ids in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes that they decode to, in one pass."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path, pattern)
        counts, id_digests, text_digests = [], [], []
        for text in texts_of(part):
            ids = bpe.encode(text)
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
            digest = hashlib.sha256()
            for decoded in bpe.decode(ids):
                digest.update(decoded.encode())
            text_digests.append(digest.hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
