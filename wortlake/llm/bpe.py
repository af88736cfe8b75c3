"""Byte-pair encoding by backtracking, exact and in linear time, over whole batches of texts.

Method: an Aho-Corasick automaton over the vocabulary gives the longest token at every byte of a piece of
text; tokens are taken greedily, each checked against a table of compatible pairs (two tokens may stand
side by side only if merging in rank order would never join bytes across their border); where a pair is
not compatible the next shorter token is tried, and where none is left the last token is taken back. A
bitmap of dead ends keeps that linear. Decoding copies bytes by an offset table of the vocabulary.

The text is cut into pieces the way the vocabulary's public pattern does, with array operations over the
classes of code points; pieces that are equal within a batch are encoded once.
"""

from __future__ import annotations

import base64
import random
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np

VOCABULARIES = "/opt/tokenizers"  # a parameter everywhere; the files are read on the driver and sent from there
OTHER, LETTER, NUMBER, SPACE = range(4)
# Code points with the property White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0                　"
_NONE = (1 << 31) - 1
_WORD_START = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")
CHUNK = 1 << 20


@dataclass(frozen=True)
class Tables:
    """A vocabulary as arrays: `data` holds all tokens end to end, token i is data[offsets[i]:offsets[i + 1]].

    left and right are the tokens of which i was merged (i itself for a byte), shorter the longest token that
    is a proper prefix of i. Their size is that of the vocabulary, whatever the corpus.
    """

    name: str
    data: bytes
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shorter: np.ndarray
    classes: bytes

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids, by the offset table; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.frombuffer(self.data, np.uint8)[at].tobytes().decode("utf-8", "replace")


def compatible(left: Sequence[int], right: Sequence[int], merged: dict[int, int], a: int, b: int) -> bool:
    """Whether a and b may be neighbours: no pair of parts along their border merges before both are complete."""
    limit = _NONE
    while True:
        if merged.get(a << 20 | b, _NONE) < limit:
            return False
        if a > b:
            limit, whole = a, a
            a = right[a]
            if a == whole:
                limit, whole = b + 1, b
                b = left[b]
                if b == whole:
                    return True
        else:
            limit, whole = b + 1, b
            b = left[b]
            if b == whole:
                limit, whole = a, a
                a = right[a]
                if a == whole:
                    return True


def code_point_classes() -> bytes:
    """The class of each code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = bytearray(kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1))
    for char in WHITE_SPACE:
        out[ord(char)] = SPACE
    return bytes(out)


@cache
def load(vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES) -> Tables:
    """The tables of a rank file (lines of a token in base 64 and its rank)."""
    ranked = (line.split() for line in Path(folder, vocabulary).read_bytes().splitlines() if line.strip())
    ids = {base64.b64decode(token): int(rank) for token, rank in ranked}
    tokens = sorted(ids, key=ids.__getitem__)
    if [ids[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"{vocabulary}: the ranks have gaps")
    left, right, shorter = list(range(len(tokens))), list(range(len(tokens))), [-1] * len(tokens)
    merged: dict[int, int] = {}
    for i, token in enumerate(tokens):
        prefixes = [(ids[token[:k]], k) for k in range(len(token) - 1, 0, -1) if token[:k] in ids]
        shorter[i] = prefixes[0][0] if prefixes else -1
        for a, k in prefixes:
            b = ids.get(token[k:], _NONE)
            if a < i and b < i and compatible(left, right, merged, a, b):
                left[i], right[i], merged[a << 20 | b] = a, b, i
                break
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    arrays = (np.array(x, np.int32) for x in (left, right, shorter))
    return Tables(f"{folder}/{vocabulary}", b"".join(tokens), offsets, *arrays, code_point_classes())


class Encoder:
    """Encodes texts with the given tables. One per Python worker, see `encoder`."""

    CACHED, CACHED_BYTES = 150_000, 48  # pieces kept; a full cache starts anew

    def __init__(self, tables: Tables):
        import ahocorasick

        self.tables = tables
        at = tables.offsets.tolist()
        self.tokens = [tables.data[a:b] for a, b in zip(at, at[1:], strict=False)]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = [len(t) for t in self.tokens]
        self.left, self.right, self.shorter = (x.tolist() for x in (tables.left, tables.right, tables.shorter))
        self.merged = {a << 20 | b: i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a != i}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.classes = np.frombuffer(tables.classes, np.uint8)
        self.compatible: dict[int, bool] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        draw = random.Random(7)
        self.scatter = np.array([draw.getrandbits(64) | 1 for _ in range(256)], np.uint64)
        self.base = draw.getrandbits(64) | 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece of text."""
        whole = self.ids.get(piece)
        if whole is not None:
            return (whole,)
        found = self.pieces.get(piece)
        if found is None:
            found = self._backtrack(piece)
            if len(piece) <= self.CACHED_BYTES:
                if len(self.pieces) >= self.CACHED:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _backtrack(self, piece: bytes) -> tuple[int, ...]:
        sizes, shorter, known = self.sizes, self.shorter, self.compatible
        longest = [0] * len(piece)
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[i]] = i
        alive = bytearray(b"\1") * (len(piece) + 1)
        taken: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + sizes[token]
            if alive[end]:
                if not taken:
                    fits = True
                else:
                    pair = taken[-1] << 20 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        fits = known[pair] = compatible(self.left, self.right, self.merged, taken[-1], token)
                if fits:
                    taken.append(token)
                    at = end
                    if at < len(piece):
                        token = longest[at]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = taken.pop()
                at -= sizes[token]
        return tuple(taken)

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start: points are the code points of texts end to end, first marks where a text starts."""
        kind = self.classes[points]
        start = first.copy()[:-1]
        start[1:] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(start)
        ends = np.append(runs[1:], len(points))
        # White space before something else: its last character stands alone, or goes with what follows if it is a space.
        last = ends[(kind[runs] == SPACE) & ~first[ends]] - 1
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # Contractions: an apostrophe that starts a piece takes some letters with it.
        mark = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:-1])
        one = points[mark + 1]
        two = np.where((mark + 2 < len(points)) & ~first[np.minimum(mark + 2, len(points))], points[np.minimum(mark + 2, len(points) - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        mark, size = mark[short | long], np.where(short, 2, 3)[short | long]
        start[mark + 1] = False
        rest = mark + size
        rest = rest[rest < len(points)]
        start[rest[kind[rest] == LETTER]] = True
        return np.flatnonzero(start)

    def _hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.powers) < n:
            grown = np.full(n, self.base, np.uint64)
            grown[0] = 1
            self.powers = np.cumprod(grown, dtype=np.uint64)
            grown[1:] = pow(self.base, -1, 1 << 64)
            self.inverses = np.cumprod(grown, dtype=np.uint64)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.scatter[data] * self.powers[: n - 1], out=sums[1:])
        return (sums[end] - sums[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        counts = np.zeros(len(texts), np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), counts
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.cumsum(lengths) - lengths
        first = np.zeros(len(points) + 1, bool)
        first[begins] = first[-1] = True
        starts = self._starts(points, first)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        to_byte = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=to_byte[1:])
        raw = joined.encode("utf-8")
        data = np.frombuffer(raw, np.uint8)
        begin = to_byte[starts]
        end = np.append(begin[1:], len(data))
        codes, unique = pd.factorize(self._hashes(data, begin, end))
        shown = np.zeros(len(unique), np.int64)
        shown[codes[::-1]] = np.arange(len(codes))[::-1]
        # Equal hashes must be equal pieces; every byte is compared with that of the piece shown first.
        size = end - begin
        same = (size == size[shown][codes]).all() and (data[np.repeat(begin[shown][codes] - begin, size) + np.arange(len(data))] == data).all()
        if not same:
            codes, shown = np.arange(len(begin)), np.arange(len(begin))
        found = [self.piece(raw[a:b]) for a, b in zip(begin[shown].tolist(), end[shown].tolist(), strict=True)]
        per = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(per.sum()))
        offset = np.cumsum(per) - per
        each = per[codes]
        total = np.cumsum(each)
        ids = flat[np.repeat(offset[codes] - (total - each), each) + np.arange(total[-1])]
        before = np.append(0, total)[np.searchsorted(starts, begins)]
        counts[:] = np.diff(np.append(before, total[-1]))
        return ids, counts

    def batches(self, texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids end to end and the number of each text, for the texts in order, some texts at a time.

        Null is as the empty text, which has no ids. A very long text is cut for the work at starts of white
        space, where a piece always starts, and comes out whole.
        """
        waiting: list[str] = []
        owners: list[int] = []
        held = n = 0

        def flush():
            done, group, size = [], [], 0
            for part in [*waiting, None]:
                if group and (part is None or size + len(part) > 2 * CHUNK):
                    done.append(self._chunk(group))
                    group, size = [], 0
                if part is not None:
                    group.append(part)
                    size += len(part)
            counts = np.concatenate([c for _, c in done])
            return np.concatenate([i for i, _ in done]), np.bincount(np.array(owners), counts, owners[-1] + 1).astype(np.int64)

        for text in texts:
            text = text or ""
            while len(text) > 2 * CHUNK and (cut := _WORD_START.search(text, CHUNK)):
                waiting.append(text[: cut.start()])
                owners.append(n)
                text = text[cut.start() :]
            waiting.append(text)
            owners.append(n)
            held, n = held + len(text), n + 1
            if held >= CHUNK or n >= 50_000:
                yield flush()
                waiting, owners, held, n = [], [], 0, 0
        if owners:
            yield flush()

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text."""
        parts = list(self.batches(texts)) or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


_ENCODERS: dict[str, Encoder] = {}


def encoder(tables: Tables) -> Encoder:
    """This process's encoder for the tables."""
    if tables.name not in _ENCODERS:
        _ENCODERS[tables.name] = Encoder(tables)
    return _ENCODERS[tables.name]
