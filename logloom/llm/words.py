"""Words of Arrow text columns as 64-bit hashes, made with numpy: no Python object per word.

A word is a run of bytes without ASCII white space, A-Z in lower case. Equal words have equal hashes in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACES = [9, 10, 11, 12, 13, 32]
_SPACE = np.zeros(256, bool)
_SPACE[_SPACES] = True
_DEPTH = 32  # longer words are hashed one by one
_TABLE = np.random.default_rng(20260101).integers(0, 2**64, (_DEPTH, 256), dtype=np.uint64)  # a random number for each byte at each place of a word; a word's hash is their sum
_TABLE[:, 65:91] = _TABLE[:, 97:123]
_TABLE[:, _SPACES] = 0
_TABLE = _TABLE.ravel()
_STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text starts (and the last one ends); nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where words start in the texts."""
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begin[first] = ~space[first]
    return np.flatnonzero(begin)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of the word at each start."""
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(data))
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + _STEP, "right")))
        own, length = starts[k:stop] - starts[k], ends[k:stop] - starts[k:stop]
        place = np.arange(ends[stop - 1] - starts[k])
        place -= np.repeat(own, length)
        np.minimum(place, _DEPTH - 1, out=place)
        place <<= 8
        place |= data[starts[k] : ends[stop - 1]]
        out[k:stop] = np.add.reduceat(_TABLE[place], own)
        for i in np.flatnonzero(length >= _DEPTH) + k:
            word = data[starts[i] : ends[i]].tobytes().split(None, 1)[0]
            if len(word) >= _DEPTH:
                out[i] = xxhash.xxh64_intdigest(word.lower())
        k = stop
    return out


def by_group(group: np.ndarray, *value: np.ndarray) -> np.ndarray:
    """Order by group (ascending numbers already), then by the values: uint8 or uint64, the first counts most. By one packed key, or column by
    column where two different rows pack alike."""
    key = group.astype(np.uint64)
    room = 64 - (int(group[-1]).bit_length() if len(group) else 0)
    for v in value:
        width = 8 if v.dtype == np.uint8 else min(room, 64)
        key = (key << np.uint64(width)) | (v.astype(np.uint64) if v.dtype == np.uint8 else v >> np.uint64(64 - width)) if width < 64 else v
        room -= width
    order = np.argsort(key)
    ordered = key[order]
    alike = np.flatnonzero(ordered[1:] == ordered[:-1])
    if len(alike) and any((v[order[alike]] != v[order[alike + 1]]).any() for v in value):
        return np.lexsort((*value[::-1], group))
    return order


class Lines:
    """The lines with words of a text column: owner (row), number (of the line in its text), and their distinct word hashes by line. With asked (which
    of the hashes it gets are sought), only lines that hold a sought one."""

    def __init__(self, column: pa.Array, asked=None):
        data, at = bytes_of(column)
        starts = word_starts(data, at)
        word = word_hashes(data, starts)
        line_at = np.union1d(np.flatnonzero(data == 10) + 1, at[:-1])
        line_at = line_at[line_at < len(data)]
        size = np.diff(np.append(np.searchsorted(starts, line_at), len(starts)))
        of = np.searchsorted(at, line_at, "right") - 1
        number = np.arange(len(line_at)) - np.searchsorted(line_at, at[:-1])[of]
        has = size > 0
        self.owner, self.number, size = of[has], number[has], size[has]
        line = np.repeat(np.arange(len(size)), size)
        if asked is not None:
            held = np.zeros(len(size), bool)
            held[line[asked(word)]] = True
            word = word[held[line]]
            self.owner, self.number, size = self.owner[held], self.number[held], size[held]
            line = np.repeat(np.arange(len(size)), size)
        order = by_group(line, word)
        word = word[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
        self.token, self.line = word[new], line[new]
        self.start = np.searchsorted(self.line, np.arange(len(size)))
        self.n = np.diff(np.append(self.start, len(self.line)))

    def _sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.start) if len(self.n) else np.empty(0, np.uint64)

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each line's word set."""
        n = self.n.astype(np.uint64)
        return tuple(mix(self._sums(mix(self.token + np.uint64(seed))) + n) for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

    def sketch(self, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Parity of the words in each of 64 classes: two sets' sketches differ in no more bits than the sets differ in words. Sets of at
        least `wide` words have two halves, by a further bit of a word's hash, which together are the sketch of a smaller set (whose second half is 0)."""
        if not len(self.n):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        x = mix(self.token)
        bit = np.uint64(1) << (x & np.uint64(63))
        other = ((x >> np.uint64(63)) == 1) & (self.n[self.line] >= wide)
        zero = np.uint64(0)
        return np.bitwise_xor.reduceat(np.where(other, zero, bit), self.start), np.bitwise_xor.reduceat(np.where(other, bit, zero), self.start)
