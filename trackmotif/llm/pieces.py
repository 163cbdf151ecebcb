"""Texts as pieces that the byte-level word pattern never crosses, many texts at a time, as arrays.

A space followed by something else than white space always begins a new word of the pattern, whatever stands before it.
Texts are cut at those spaces; a piece is known by a 64-bit hash, which prefix sums give for all pieces at once. Equal
pieces are resolved to ids once a chunk of texts, and stay in a table of bounded size between chunks.

Unequal pieces of equal hashes would get each other's ids. ``encode`` therefore takes the ids' bytes, and encodes texts that
these don't spell again, each piece by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from trackmotif.llm.words import span_hashes

#: Texts are handled in chunks of so many bytes; so many pieces stay between chunks.
CHUNK_BYTES, MEMO_PIECES = 1_000_000, 500_000

_LETTER, _DIGIT, _MARK = np.zeros((3, 256), bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

# Unicode's White_Space beyond ASCII, as UTF-8 with the last byte of short ones left out.
_WIDE_SPACES = np.array([0xC28500, 0xC2A000, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080], np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The pieces of texts (UTF-8): where they start and how long they are, their keys, and which piece each text starts with.

    ``core`` is how many bytes the first word of the pattern has, where a piece is an optional space with letters (below
    U+0250) or digits, and then maybe ASCII marks, which are the second word; 0 for all other pieces.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"".join(texts)
        self.raw = raw = np.frombuffer(joined, np.uint8)
        n = len(raw)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(sizes)
        begins = self.text_ends - sizes
        cut = np.zeros(n + 1, bool)
        at = np.flatnonzero(raw == 32)
        following = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
        after = following[at + 1]
        ok = (after != 32) & ((after < 9) | (after > 13))
        wide = np.flatnonzero((after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3)))
        code = (after[wide] << 16) | (following[at[wide] + 2] << 8) | np.where(after[wide] == 0xC2, 0, following[at[wide] + 3])
        ok[wide[np.isin(code, _WIDE_SPACES)]] = False
        cut[at[ok]] = True
        last = np.zeros(n + 1, bool)
        last[self.text_ends] = True
        cut[:-1] &= ~last[1:]  # a space that ends a text
        cut[begins[sizes > 0]] = True
        self.starts = np.flatnonzero(cut[:n])
        ends = np.append(self.starts[1:], n) if n else self.starts
        self.lengths = ends - self.starts
        self.first = np.append(np.searchsorted(self.starts, begins), len(self.starts))
        self.keys = span_hashes(raw, self.starts, ends)
        self.core = self._cores(ends, following)

    def _cores(self, ends: np.ndarray, following: np.ndarray) -> np.ndarray:
        raw, starts = self.raw, self.starts
        letter, digit, mark = _LETTER[raw], _DIGIT[raw], _MARK[raw]
        lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))
        lead = lead[(raw[lead] != 0xC3) | ((following[lead + 1] != 0x97) & (following[lead + 1] != 0xB7))]  # × and ÷ are none
        letter[lead] = letter[lead + 1] = True
        later = np.zeros(len(raw), bool)
        later[1:] = (letter | digit)[1:] & mark[:-1]
        total = lambda x: np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)])
        within = lambda t, a=starts: (t[ends] - t[a]).astype(np.int64)
        letters, digits, marks = (within(total(x)) for x in (letter, digit, mark))
        head = (raw[starts] == 32).astype(np.int64)
        core = letters + digits
        whole = (core > 0) & ((letters == 0) | (digits == 0)) & (head + core + marks == self.lengths)
        return np.where(whole & (within(total(later), np.minimum(starts + 1, len(raw))) == 0), head + core, 0)

    def piece(self, k: int) -> bytes:
        a = int(self.starts[k])
        return self.raw[a : a + int(self.lengths[k])].tobytes()


class Memo:
    """Rows of numbers by 64-bit key, in an open-addressed table; emptied when it is full."""

    def __init__(self, kind: type, capacity: int = MEMO_PIECES):
        self.kind, self.capacity = kind, capacity
        self.clear(0)

    def clear(self, least: int) -> None:
        """Empty, with room for ``least`` keys."""
        room = max(self.capacity, least)
        self.bits = int(np.ceil(np.log2(2 * room)))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.starts, self.lengths = np.zeros(room, np.uint64), np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.flat, self.used, self.count, self.room = np.zeros(4 * room, self.kind), 0, 0, room

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slots[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out

    def add(self, keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Rows of distinct keys that are not there yet."""
        rows = np.arange(self.count, self.count + len(keys))
        self.keys[rows], self.lengths[rows] = keys, lengths
        self.starts[rows] = self.used + np.cumsum(lengths) - lengths
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.count += len(keys)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):  # each free slot takes the first that comes; the others move on
            free = self.slots[at[todo]] < 0
            slot, where = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][where]
            self.slots[slot] = rows[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return rows

    def values(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of rows, and their numbers one after the other."""
        lengths = self.lengths[rows].astype(np.int64)
        return lengths, self.flat[ranges(self.starts[rows], lengths)]


def chunks(texts: Iterable[bytes], size: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    out, held = [], 0
    for t in texts:
        out.append(t)
        held += len(t)
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


class Coder:
    """Ids of texts. ``resolve`` gives lengths and ids of the numbered pieces; ``special`` strings have an id each, and cut
    texts before all else; ``bytes_of`` are the bytes that each id stands for."""

    def __init__(self, resolve: Callable[[Pieces, np.ndarray], tuple[np.ndarray, np.ndarray]], special: dict[str, int], bytes_of: list[bytes], kind: type = np.int32, memo_pieces: int = MEMO_PIECES):
        self.resolve, self.kind = resolve, kind
        self.special = {s.encode(): i for s, i in special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None
        self.memo = Memo(kind, memo_pieces)
        self.bytes_of = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.sizes = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def _rows(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        keys, first, place = np.unique(p.keys, return_index=True, return_inverse=True)
        rows = self.memo.find(keys)
        new = rows < 0
        if self.memo.count + new.sum() > self.memo.room:
            self.memo.clear(len(keys))
            new[:] = True
        if new.any():
            rows[new] = self.memo.add(keys[new], *self.resolve(p, first[new]))
        return self.memo.values(rows[place])

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special strings, one after the other, and where each text's end."""
        p = Pieces(texts)
        lengths, ids = self._rows(p)
        ends = np.concatenate([[0], np.cumsum(lengths)])[p.first[1:]]
        return ids, ends

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and how many each."""
        sizes = self.sizes[ids]
        return self.bytes_of[ranges(self.begins[ids], sizes)], sizes

    def _mended(self, text: bytes) -> np.ndarray:
        """Ids of one text, each piece resolved by itself; special strings are taken out first."""
        out = [np.zeros(0, self.kind)]
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], self.kind))
            elif part:
                p = Pieces([part])
                out += [self.resolve(p, np.array([k]))[1].astype(self.kind) for k in range(len(p.starts))]
        return np.concatenate(out)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each text of a chunk, and the bytes they stand for."""
        special = [self.cut is not None and self.cut.search(t) is not None for t in texts]
        ids, ends = self._plain([b"" if s else t for t, s in zip(texts, special, strict=True)])
        spelled, sizes = self.spelled(ids)
        all_bytes = spelled.tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])
        a = 0
        for text, own, b in zip(texts, special, ends.tolist(), strict=True):
            out, back = ids[a:b], all_bytes[at[a] : at[b]]
            if own or back != text:
                out = self._mended(text)
                back = self.spelled(out)[0].tobytes()
            yield out, back
            a = b
