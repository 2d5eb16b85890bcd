"""Vectorised 64-bit hashes over bytes and words, for use inside tasks."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the splitmix64 finaliser). Works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# One random word per byte value, so that no two bytes differ by a small number.
_BYTES = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_MULTIPLIER))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier ("up") or of its inverse ("down")."""
    held = _powers[which]
    if len(held) < n:
        base = np.full(max(n, 2 * len(held), 1 << 16), _MULTIPLIER if which == "up" else _INVERSE, np.uint64)
        base[0] = 1
        held = _powers[which] = np.cumprod(base)
    return held[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` gives the hash of any span of the bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power("down", len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span that depends on its bytes and length alone, not on where it stands."""
    raw = (sums[ends] - sums[starts]) * _power("up", len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_hashes(data: bytes) -> np.ndarray:
    """A hash per word; words are what stands between ASCII white space (blank and 0x09 to 0x0D)."""
    held = np.frombuffer(data, np.uint8)
    if not len(held):
        return np.zeros(0, np.uint64)
    space = np.empty(len(held) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[held]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return span_hash(prefix_hash(held), edges[0::2], edges[1::2])


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of `width` words, A-Z lower-cased, sorted; fewer words count as one run, none as none."""
    words = word_hashes(as_bytes(text).lower())
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    run = np.full(n, min(len(words), width), np.uint64)
    for j in range(min(len(words), width)):
        run = mix(run * np.uint64(_MULTIPLIER) + words[j:j + n])
    return np.unique(run)
