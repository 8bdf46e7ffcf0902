"""Sets of hashed word shingles."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import U64, Rolling, as_bytes, lower_bytes, mix, word_bounds


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of `size` lower-cased words. A text with
    fewer words, but some, has one shingle of them all; one without words, or null, has none."""
    raw = [as_bytes(t) for t in texts]
    data = lower_bytes(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
    start, end = word_bounds(data)
    word = Rolling(data).spans(start, end)
    first = np.searchsorted(start, begin)
    n = np.diff(np.append(first, len(start)))
    mixed = np.zeros(max(0, len(word) - size + 1), U64)
    for i in range(size):
        mixed = mix(mixed + word[i : i + len(mixed)] + U64(i + 1))
    out = []
    for a, k in zip(first.tolist(), n.tolist(), strict=True):
        if k >= size:
            out.append(np.unique(mixed[a : a + k - size + 1]))
        elif k:
            h = np.array([k], U64)
            for i in range(a, a + k):
                h = mix(h + word[i : i + 1] + U64(size + k))
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
