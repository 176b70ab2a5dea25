"""Word shingles of whole texts as 64-bit hashes, computed with numpy inside tasks.

Words are the maximal runs of bytes that are not ASCII white space
(``[^\\x20\\x09-\\x0D]+``), after lower-casing A-Z only.  A text's set holds one
hash for each distinct run of ``width`` words; a text with fewer words is one
shingle as a whole, and a text without words has the empty set.
"""

from __future__ import annotations

import numpy as np

#: Bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multiplier of the polynomial that hashes a word's bytes; its inverse mod 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: A random 64-bit value for each byte, so that no byte counts as zero.
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _P, np.uint64)
        down = np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed at one time; a longer text is taken in blocks cut between words.
BLOCK = 1 << 20


def _block_hashes(raw: np.ndarray, lower: bool) -> np.ndarray:
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value ^ (ends - starts).astype(np.uint64))


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= BLOCK:
        return _block_hashes(raw, lower)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):  # on to the next white space, so that no word is cut
            gap = np.flatnonzero(_SPACE[raw[end : end + BLOCK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(raw), end + BLOCK)
        parts.append(_block_hashes(raw[at:end], lower))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; None and '' give none."""
    if not text:
        return np.empty(0, np.uint64)
    words = word_hashes(text)
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(width, len(words))
    runs = len(words) - n + 1
    value = np.full(runs, n, np.uint64)  # the number of words tells short texts apart
    for k in range(n):
        value *= np.uint64(0xD6E8FEB86659FD93)
        value += words[k : k + runs]
        value ^= value >> np.uint64(32)
    return np.unique(mix(value))
