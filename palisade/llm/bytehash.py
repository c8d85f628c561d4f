"""Vectorised hashes of words, word shingles and byte strings of many texts.

Words are read eight bytes at a time, and each eight are stirred into the word's hash, so
unlike sums of powers no family of texts collides by construction. Words above LONG bytes
are hashed by XXH64 one by one. Where identity is claimed, `Spelling` compares the bytes.

Byte strings (`byte_sums`) have prefix sums modulo 2**64 of a random value per byte times
powers; slices take two look-ups. Such sums can be made to collide for strings of 1,024
bytes and more, so they are used for shorter ones only.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd multiplier, its inverse modulo 2**64, and the seed of the byte values.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_SEED = 20_011
#: Texts are hashed in slices of about so many bytes, cut between words.
SLICE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64

_VALUES = np.random.default_rng(_SEED).integers(0, 2**64, 256, dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: What is kept of eight bytes of which only the first k belong to a word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        room = max(n, SLICE + 1024)
        have = np.full(room, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_sums(raw: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Prefix sums of byte values times powers: slice [a, b) has (sums[b] - sums[a]) * INVERSE**a."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * powers(BASE, len(raw)), out=sums[1:])
    return sums


def lowered(raw: np.ndarray) -> np.ndarray:
    """A to Z in lower case."""
    return raw + ((raw - np.uint8(65) < 26) * np.uint8(32))


class Eights:
    """Eight bytes from any place of an array of bytes, as one number; zeros behind its end."""

    def __init__(self, raw: np.ndarray):
        room = np.zeros(len(raw) // 8 * 8 + 16, np.uint8)
        room[: len(raw)] = raw
        self.whole = room.view("<u8")

    def at(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each place the next bytes, eight at most and no more than `sizes`."""
        cell, shift = places >> 3, (places & 7).astype(np.uint64) << np.uint64(3)
        out = self.whole[cell] >> shift
        out |= (self.whole[cell + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        out &= _KEEP[np.minimum(sizes, 8)]
        return out


def _stirred(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    eights, sizes = Eights(raw), ends - starts
    h = mixed(eights.at(starts, sizes) ^ (sizes.astype(np.uint64) * np.uint64(BASE)))
    mine = np.nonzero((sizes > 8) & (sizes <= LONG))[0]
    for k in range(8, LONG, 8):
        mine = mine[sizes[mine] > k]
        if not len(mine):
            break
        h[mine] = mixed(h[mine] * np.uint64(BASE) + eights.at(starts[mine] + k, sizes[mine] - k))
    for i in np.nonzero(sizes > LONG)[0].tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), _SEED)
    return h


def _slice_words(raw: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~BLANK[raw]
    edge = np.nonzero(np.diff(solid, prepend=False, append=False))[0]
    starts, ends = edge[::2], edge[1::2]
    return _stirred(lowered(raw) if fold else raw, starts, ends), starts, ends


def word_hashes(blob: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each blank-separated word; `fold` lower-cases A to Z."""
    raw, at, parts = np.frombuffer(blob, np.uint8), 0, []
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        while end < len(raw) and not BLANK[raw[end - 1]]:
            rest = np.nonzero(BLANK[raw[end : end + SLICE]])[0]
            end = end + int(rest[0]) + 1 if len(rest) else min(end + SLICE, len(raw))
        h, s, e = _slice_words(raw[at:end], fold)
        parts.append((h, s + at, e + at))
        at = end
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, a few."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= np.uint64(BASE)
        total += hashes[k : k + n]
    return mixed(total)


class Grown:
    """An array that is appended to."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1024, kind), 0

    def all(self) -> np.ndarray:
        return self.room[: self.size]

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, len(self.room) * 3 // 2), self.room.dtype)
            room[: self.size] = self.all()
            self.room = room
        self.room[self.size : end] = values
        self.size = end


class Spelling:
    """The bytes of numbered words, to tell whether a word is the one that its hash stands for."""

    def __init__(self):
        self.pool, self.at, self.sizes = Grown(np.uint64), Grown(np.int64), Grown(np.int32)
        self.long: dict[int, bytes] = {}

    def add(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """The next numbers go to these words."""
        eights, sizes, known = Eights(raw), ends - starts, self.sizes.size
        for i in np.nonzero(sizes > LONG)[0].tolist():
            self.long[known + i] = raw[starts[i] : ends[i]].tobytes()
        cells = np.where(sizes <= LONG, (sizes + 7) >> 3, 0)
        begin = np.cumsum(cells) - cells
        owner = np.repeat(np.arange(len(sizes)), cells)
        step = 8 * (np.arange(len(owner)) - begin[owner])
        self.at.extend(begin + self.pool.size)
        self.pool.extend(eights.at(starts[owner] + step, sizes[owner] - step))
        self.sizes.extend(sizes)

    def differs(self, numbers: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of words whose bytes are not those of the number they are given."""
        eights, sizes = Eights(raw), ends - starts
        wrong = sizes != self.sizes.all()[numbers]
        pool, at, mine = self.pool.all(), self.at.all(), np.nonzero(~wrong & (sizes <= LONG))[0]
        for k in range(0, LONG, 8):
            mine = mine[sizes[mine] > k]
            if not len(mine):
                break
            wrong[mine] |= pool[at[numbers[mine]] + k // 8] != eights.at(starts[mine] + k, sizes[mine] - k)
        for i in np.nonzero(~wrong & (sizes > LONG))[0].tolist():
            wrong[i] = self.long[int(numbers[i])] != raw[starts[i] : ends[i]].tobytes()
        return np.nonzero(wrong)[0]


class HashIndex:
    """A growing map from 64-bit hashes to small numbers, looked up for whole arrays.

    Open addressing with linear probing; each round of probing is one array operation.
    """

    def __init__(self, bits: int = 16):
        self.size = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is unknown."""
        slots, mask = self._slots(hashes), (1 << self.bits) - 1
        found = self.values[slots]
        wrong = np.nonzero((found >= 0) & (self.keys[slots] != hashes))[0]
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & mask
            at = slots[wrong]
            found[wrong] = self.values[at]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[at] != hashes[wrong])]
        return found

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Enter distinct unknown hashes; the table is kept at most half full."""
        if 2 * (self.size + len(hashes)) > 1 << self.bits:
            used = self.values >= 0
            old, kept = self.keys[used], self.values[used]
            self._make(max(self.bits + 1, int(2 * (self.size + len(hashes))).bit_length() + 1))
            self._enter(old, kept)
        self._enter(hashes, values.astype(np.int32))
        self.size += len(hashes)

    def _enter(self, hashes: np.ndarray, values: np.ndarray) -> None:
        slots, left = self._slots(hashes), np.arange(len(hashes))
        while len(left):
            free = left[self.values[slots[left]] < 0]
            self.values[slots[free]] = values[free]
            self.keys[slots[free]] = hashes[free]
            left = left[self.keys[slots[left]] != hashes[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
