"""Words of many texts as 64-bit fingerprints, by numpy over their bytes and without a Python object for each word.

Two polynomial hashes modulo 2**64, mixed into one number: among V distinct words two share a fingerprint with a chance
of about V**2 / 2**65 (under one in a million for five million words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers and their inverses modulo 2**64.
_P = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_INVERSE = [np.uint64(pow(int(p), -1, 1 << 64)) for p in _P]
_POWERS: list[np.ndarray] = []
#: Fixed value: the bytes that separate words.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that are hashed together.
PIECE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (*_P, *_INVERSE)]
    return _POWERS


def in_pieces(texts: list[str | None], size: int = PIECE_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of about `size` characters together."""
    first, own, n = 0, [], 0
    for i, t in enumerate(texts):
        own.append(t)
        n += len(t or "")
        if n >= size:
            yield first, own
            first, own, n = i + 1, [], 0
    if own:
        yield first, own


def fingerprints(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the stretches [start, end) of the bytes b."""
    p, q, ip, iq = _powers(len(b) + 1)
    out = np.zeros(len(start), np.uint64)
    big = b.astype(np.uint64) + np.uint64(1)
    for power, inverse, turned in ((p, ip, np.uint64(0)), (q, iq, np.uint64(29))):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(big * power[: len(b)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverse[start])
        out = mix(out ^ ((h << turned) | (h >> (np.uint64(64) - turned) if turned else np.uint64(0))))
    return out


def hashed_words(texts: list[str | None], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all words in turn, the last two bytes of each (high byte first), and the words of each text.

    A-Z count as lower case; `table` (256 bytes) may turn more bytes into others first. A null text has no word.
    """
    coded = [(t.encode("utf-8", "surrogatepass") if t else b"") for t in texts]
    whole = b" " + b" ".join(coded) + b" "
    whole = whole.lower() if table is None else whole.lower().translate(table)
    b = np.frombuffer(whole, np.uint8)
    space = np.zeros(256, bool)
    space[list(SPACE_BYTES)] = True
    inside = ~space[b]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    last = b[end - 1].astype(np.int64) + 256 * np.where(end - start > 1, b[end - 2].astype(np.int64), 0)
    begins = 1 + np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]).astype(np.int64)
    return fingerprints(b, start, end), last, np.diff(np.searchsorted(start, begins))
