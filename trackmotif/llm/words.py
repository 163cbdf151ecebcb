"""Words of texts and their hashes, shared by the operators: found as arrays, without an object a word."""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of the splitmix64 finaliser
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that are looked at together, cut where a word ends.
BLOCK = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of prefix sums."""
    n = len(raw) + 1
    if len(_powers[0]) < n:
        for k, base in enumerate((_POWER, _INVERSE)):
            steps = np.full(n, base)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    sums = np.zeros(n, np.uint64)
    np.cumsum(_OF_BYTE[raw] * _powers[1][: n - 1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[0][starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a text, with A-Z as a-z: a 64-bit hash of each, and its bytes where they are asked for."""

    def __init__(self, raw: bytes):
        self.raw, codes = raw, np.frombuffer(raw, np.uint8)
        parts = []
        at = 0
        while at < len(codes):
            end = min(at + BLOCK, len(codes))
            while end < len(codes) and not _SPACE[codes[end]]:
                end = min(end + 4096, len(codes))
                gap = np.flatnonzero(_SPACE[codes[max(at, end - 4096) : end]])
                if len(gap):
                    end = max(at, end - 4096) + int(gap[-1])
                    break
            block = codes[at:end]
            inside = np.zeros(len(block) + 2, np.int8)
            inside[1:-1] = ~_SPACE[block]
            edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
            parts.append((edges + at, span_hashes(block, edges[:, 0], edges[:, 1])))
            at = max(end, at + 1)
        self.edges = np.concatenate([np.zeros((0, 2), np.int64), *(e for e, _ in parts)])
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in parts)])

    def __len__(self) -> int:
        return len(self.hashes)

    def word(self, k: int) -> bytes:
        return self.raw[self.edges[k, 0] : self.edges[k, 1]]

    def list(self) -> list[bytes]:
        return self.raw.split()


def spaced(text: str | None) -> Words:
    """Words that end at a space or at U+0009 to U+000D."""
    return Words((text or "").encode().translate(_LOWER))


def lettered(text: str | None) -> Words:
    """Runs of ASCII letters, digits and everything beyond ASCII."""
    return Words((text or "").encode().translate(_LETTERS))


def joined(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The lettered words of many texts at once, and the number of each word's text."""
    words = Words(b"\n".join(texts).translate(_LETTERS))
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return words, np.searchsorted(ends, words.edges[:, 0], "right")
