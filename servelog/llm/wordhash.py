"""64-bit hashes of the words of many texts at once, without a Python loop over words.

A word's hash is a polynomial of its bytes modulo 2^64, taken from prefix sums and
then mixed, so it depends on the word alone.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
# A-Z to lower case, ASCII white space to a space, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SPACE else b for b in range(256))
BLOCK_BYTES = 2_000_000
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last step)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        row = np.full(max(n, BLOCK_BYTES), _BASE if kind == "up" else _INVERSE, "uint64")
        row[0] = 1
        have = _powers[kind] = np.multiply.accumulate(row)
        if n > 4 * BLOCK_BYTES:  # one very long text: don't hold on to its powers
            _powers.pop(kind)
    return have


def hashed_words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash per word, bytes per word, words per text) of texts in order; words are runs
    without ASCII white space, A-Z counts as a-z."""
    joined = b" " + b" ".join(bodies) + b" "
    letters = np.frombuffer(joined.translate(LOWER), "uint8")
    space = letters == 32
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    text_ends = np.cumsum(np.fromiter((len(b) + 1 for b in bodies), "int64", len(bodies)))
    counts = np.diff(np.searchsorted(starts, text_ends, "right"), prepend=0)
    if not len(starts):
        return np.zeros(0, "uint64"), np.zeros(0, "int64"), counts
    n = len(letters)
    sums = np.cumsum((letters.astype("uint64") + np.uint64(1)) * _power("up", n)[:n], dtype="uint64")
    sums = np.concatenate([np.zeros(1, "uint64"), sums])
    return mix((sums[ends] - sums[starts]) * _power("down", n)[starts]), ends - starts, counts


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of the whole text if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, "uint64")
    for k in range(size):
        total = total * _BASE + words[k:k + n]
    return mix(total)


def blocks(sizes: list[int], limit: int = BLOCK_BYTES):
    """Slices of consecutive texts of about ``limit`` bytes, at least one text each."""
    first = held = 0
    for at, size in enumerate(sizes):
        if at > first and held + size > limit:
            yield slice(first, at)
            first, held = at, 0
        held += size
    if len(sizes) > first:
        yield slice(first, len(sizes))
