"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
#: Odd multipliers, one for each word of a shingle (fixed values).
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Words whose hashes a worker keeps before it starts anew; longer words are not kept.
_MOST, _KEPT_BYTES = 300_000, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= _KEPT_BYTES:
            if len(self) >= _MOST:
                self.clear()
            self[word] = value
        return value


_hash = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles of a text, ascending.

    Words are runs of bytes other than space and \\t to \\r with A-Z lowered, which is what bytes.lower
    and bytes.split do.  With fewer words the whole sequence is one shingle; no words, no shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_hash[w] for w in words], np.uint64)
    k = min(WIDTH, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s += h[i : i + n] * _MULTIPLIERS[i]
    return np.unique(_mix(s))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
