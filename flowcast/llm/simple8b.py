"""Simple-8b coding of integers in 64-bit words, block by block.

A word's upper four bits select how many values share the lower 60 and how wide each is. A block holds a fixed number of
values and starts at a known word, so blocks can be decoded on their own and all words of one selector at once. Values
that need more than 60 bits follow an escape word as they are. The last word of a block may cover more places than the
block has values left.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Selector: values in a word (selector 0 escapes, selector 1 is a long run of zeros). Fixed values of the format.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U = np.uint64


_SMALL = np.array([k.bit_length() for k in range(2**16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; wide values may be given one too many, which is never wrong."""
    if not len(values) or values.max() < 2**16:
        return _SMALL[values.astype(np.uint16)]
    return np.minimum(np.frexp(values.astype(np.float64))[1], 64).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the first word of each block (one more entry than blocks)."""
    n = len(values)
    if not n:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    values = values.astype(_U)
    at = np.arange(n, dtype=np.int64)
    left = np.minimum((at // BLOCK + 1) * BLOCK, n) - at
    # One row per block, with room for the longest run; places behind the last value need no bits.
    rows, room = -(-n // BLOCK), int(BLOCK + COUNTS.max())
    padded = np.zeros((rows, room), _U)
    flat = np.zeros(rows * BLOCK, _U)
    flat[:n] = values
    padded[:, :BLOCK] = flat.reshape(rows, BLOCK)
    width = np.zeros((rows, room), np.uint8)
    width[:, :BLOCK] = _widths(flat).reshape(rows, BLOCK)
    selector, widest, span = np.zeros((rows, BLOCK), np.uint8), width, 1
    for s in range(15, 0, -1):  # from few wide values to many narrow ones; a denser selector that fits takes over
        while span < COUNTS[s]:  # the widest of the next COUNTS[s] values, from two overlapping shorter runs
            step = min(span, COUNTS[s] - span)
            widest, span = np.maximum(widest[:, :-step], widest[:, step:]), span + step
        selector[widest[:, :BLOCK] <= BITS[s]] = s
    selector = selector.reshape(-1)[:n]
    covered = np.minimum(COUNTS[selector], left)
    steps, starts, i = covered.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    first = np.array(starts, np.int64)
    chosen = selector[first]
    place = np.concatenate([[0], np.cumsum(1 + (chosen == 0))])
    words, padded, cell = np.zeros(place[-1], _U), padded.reshape(-1), first + first // BLOCK * (room - BLOCK)
    for s in range(16):
        own = np.flatnonzero(chosen == s)
        if not len(own):
            continue
        if s == 0:
            words[place[own] + 1] = padded[cell[own]]
            continue
        packed, at = np.full(len(own), s << 60, _U), cell[own]
        for k in range(COUNTS[s] if BITS[s] else 0):
            packed |= padded[at + k] << _U(BITS[s] * k)
        words[place[own]] = packed
    blocks = np.searchsorted(first, np.arange(0, n, BLOCK))
    return words, np.append(place[blocks], place[-1])


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of all blocks; ``offsets`` as ``encode`` gives them."""
    out = np.zeros(n, _U)
    if not n:
        return out
    selector = (words >> _U(60)).astype(np.int64)
    is_word = np.ones(len(words), bool)
    raw = -1
    for i in np.flatnonzero(selector == 0):  # a value that follows an escape is no word of its own
        if i != raw:
            raw = i + 1
            is_word[raw] = False
    at = np.flatnonzero(is_word)
    chosen = selector[at]
    block = np.searchsorted(offsets, at, side="right") - 1
    ends = np.minimum((block + 1) * BLOCK, n)
    count = COUNTS[chosen]
    before = np.cumsum(count) - count
    first = block * BLOCK + before - before[np.searchsorted(at, offsets[:-1])][block]
    for s in range(16):
        own = np.flatnonzero(chosen == s)
        if not len(own) or s == 1:
            continue
        if s == 0:
            out[first[own]] = words[at[own] + 1]
            continue
        word, mask = words[at[own]], _U((1 << int(BITS[s])) - 1)
        start, end = first[own], ends[own]
        for k in range(COUNTS[s]):
            inside = start + k < end
            if not inside.any():
                break
            out[start[inside] + k] = (word[inside] >> _U(BITS[s] * k)) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """One block's values, read from its own words alone."""
    size = min(BLOCK, n - block * BLOCK)
    own = words[offsets[block]:offsets[block + 1]]
    return decode(own, np.array([0, len(own)]), size)
