r"""Words of many texts at once: `[^\x20\x09-\x0D]+` with A-Z lower-cased, as 64-bit hashes found by array operations over the
joined bytes of a batch instead of one Python object per word.

A word of up to 8 bytes is one machine word, mixed by bijections, so such words never collide with others of their length;
longer words are chained 8 bytes at a time, very long ones are hashed whole.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Words beyond this many bytes are hashed one by one.
LONG = 256
#: A token: CLASS bits of rarity class above HASH bits of hash. The byte above holds a group number while sets are sorted.
HASH, CLASS = 50, 6
GROUPS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


class Words:
    """starts, ends: places of the words in the joined bytes; hashes; text: the number of the text that each is in."""

    def __init__(self, texts: list[bytes]):
        self.joined = b"\n".join(texts).lower() + b"\n" * 9
        self.raw = np.frombuffer(self.joined, np.uint8)
        self.texts = len(texts)
        space = _SPACE[self.raw]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            turns = np.concatenate([[0], turns])
        self.starts, self.ends = turns[0::2], turns[1::2]
        self.hashes = self._hash()
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, at)
        self.text_starts = at
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def _hash(self) -> np.ndarray:
        eight = np.ndarray((len(self.joined) - 7,), "<u8", self.joined, strides=(1,))
        size = self.ends - self.starts
        h = mix((eight[self.starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _K[0])
        more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            rest = size[more] - k
            h[more] = mix((h[more] + _K[0]) ^ (eight[self.starts[more] + k] & _MASK[np.minimum(rest, 8)]))
            more, k = more[rest > 8], k + 8
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.joined[self.starts[i] : self.ends[i]])
        return h

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each line with a word: its text, its number in the text, and its words' end; words are in line order."""
        breaks = np.flatnonzero(self.raw == 10)
        ends = np.searchsorted(self.starts, breaks)
        full = np.flatnonzero(np.diff(ends, prepend=0))
        first = np.searchsorted(breaks, self.text_starts[:-1])  # the global number of each text's first line
        text = np.searchsorted(first, full, side="right") - 1
        return text, full - first[text], ends[full]


def ranked(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Tokens whose natural order is the rarity order given by `order` (classes by the hash's leading bits)."""
    cells = hashes >> np.uint64(64 - int(np.log2(len(order))))
    return (order[cells].astype(np.uint64) << np.uint64(HASH)) | (hashes & np.uint64(2**HASH - 1))


def sets_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's distinct tokens in order, one group after the other, and their numbers. sizes: tokens by group."""
    ends = np.cumsum(sizes)
    out, counts = [], np.zeros(len(sizes), np.int64)
    for g in range(0, len(sizes), GROUPS):
        own = sizes[g : g + GROUPS]
        lo, hi = (ends[g - 1] if g else 0), ends[min(g + GROUPS, len(sizes)) - 1]
        key = tokens[lo:hi] | (np.repeat(np.arange(len(own), dtype=np.uint64), own) << np.uint64(56))
        key.sort()
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        counts[g : g + GROUPS] = np.bincount((key >> np.uint64(56)).astype(np.int64), minlength=len(own))
        out.append(key & np.uint64(2**56 - 1))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def names_of(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set (none empty): its 128-bit name as two longs, sums of mixed hashes."""
    if not len(counts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.cumsum(counts) - counts
    one = mix((tokens & np.uint64(2**HASH - 1)) * _K[0] + _K[1])
    return np.add.reduceat(one, starts).view(np.int64), np.add.reduceat(mix(one + _K[2]), starts).view(np.int64)
