"""A table-driven byte transducer: one pass over UTF-8 bytes that counts, and marks words for a verified hash table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import with_columns
from logloom.llm.words import bytes_of

OUT, IN = 0, 1
SPACE, NEXT, UPPER, SYMBOL, OTHER = range(5)  # classes of bytes; NEXT: a byte that goes on with a code point
START, END, CAPITAL, POINT, MARK = 1, 2, 4, 8, 16  # what a step may put out
BLOCK = 1 << 20
LONG_WORD = 64


def byte_classes(symbols: bytes = b"#$%&*|") -> np.ndarray:
    """The class of each of the 256 bytes."""
    kind = np.full(256, OTHER, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[0x80:0xC0] = NEXT
    kind[ord("A") : ord("Z") + 1] = UPPER
    kind[list(symbols)] = SYMBOL
    return kind


#: The state after a byte, by class: it does not depend on the state before, so that a block of bytes steps by gathers.
AFTER = np.array([OUT, IN, IN, IN, IN], np.uint8)
#: What is put out, by state before and class.
EMIT = np.array(
    [
        [POINT, START, START | POINT | CAPITAL, START | POINT | MARK, START | POINT],
        [POINT | END, 0, POINT | CAPITAL, POINT | MARK, POINT],
    ],
    np.uint8,
)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    total, full = np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
    if full.any():
        total[full] = np.add.reduceat(flags, offsets[:-1][full], dtype=np.int64)
    return total


class SpanTable:
    """Open addressing over the words of rows. A slot holds the number of a span; a span finds itself there only if row, length and bytes agree."""

    def __init__(self, data: np.ndarray, spans: int) -> None:
        self.padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) + 1, "<u8", self.padded, strides=(1,))  # the eight bytes from each position on
        self.mask = np.int64((1 << max(4, int(2 * spans).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int64)

    def _piece(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Up to eight bytes of each span from `at` on, of which `left` belong to it."""
        keep = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (np.uint64(8) * np.clip(left, 0, 7).astype(np.uint64))) - np.uint64(1))
        return self.eight[at] & keep

    def hashes(self, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        size = end - start
        h = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ size.astype(np.uint64)
        here, at = np.flatnonzero(size <= LONG_WORD), 0
        while len(here):
            x = (h[here] ^ self._piece(start[here] + at, size[here] - at)) * np.uint64(0xFF51AFD7ED558CCD)
            h[here] = x ^ (x >> np.uint64(32))
            at += 8
            here = here[size[here] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] ^= np.uint64(hash(self.padded[start[i] : end[i]].tobytes()) & (2**64 - 1))
        x = h * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))

    def _same(self, a: tuple, b: tuple) -> np.ndarray:
        (start, end, row), (other, other_end, other_row) = a, b
        size = end - start
        equal = (size == other_end - other) & (row == other_row)
        here, at = np.flatnonzero(equal & (size <= LONG_WORD)), 0
        while len(here):
            left = size[here] - at
            ok = self._piece(start[here] + at, left) == self._piece(other[here] + at, left)
            equal[here[~ok]] = False
            at += 8
            here = here[ok & (left > 8)]
        for i in np.flatnonzero(equal & (size > LONG_WORD)).tolist():
            equal[i] = bool((self.padded[start[i] : end[i]] == self.padded[other[i] : other_end[i]]).all())
        return equal

    def first_of_each(self, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Insert all spans; true for one of each row's equal words."""
        at = (self.hashes(start, end, row) & self.mask.astype(np.uint64)).astype(np.int64)
        new, todo = np.zeros(len(start), bool), np.arange(len(start))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = free
            holder = self.slots[at[todo]]
            own = holder == todo
            new[todo[own]] = True
            todo, holder = todo[~own], holder[~own]
            todo = todo[~self._same((start[todo], end[todo], row[todo]), (start[holder], end[holder], row[holder]))]
            at[todo] = (at[todo] + 1) & self.mask
        return new


def _cuts(data: np.ndarray, kinds: np.ndarray) -> list[int]:
    """Ends of blocks of about BLOCK bytes, each after a space, so that no word is cut; a longer word makes its block longer."""
    cuts, at = [], 0
    while len(data) - at > BLOCK:
        spaces = np.flatnonzero(kinds[data[at : at + BLOCK]] == SPACE)
        end = at + BLOCK
        while not len(spaces) and end < len(data):
            spaces = end - at + np.flatnonzero(kinds[data[end : end + BLOCK]] == SPACE)[:1]
            end += BLOCK
        if not len(spaces):
            break
        at += int(spaces[-1]) + 1
        cuts.append(at)
    return [*cuts, len(data)]


def count_bytes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_points and n_symbols of each row."""
    rows = len(offsets) - 1
    total = {flag: np.zeros(rows, np.int64) for flag in (CAPITAL, POINT, MARK)}
    starts, ends, at = [], [], 0
    for cut in _cuts(data, kinds):
        kind = kinds[data[at:cut]]
        state = AFTER[kind]
        local = np.clip(offsets, at, cut) - at
        full = local[1:] > local[:-1]
        before = np.empty_like(state)
        before[1:] = state[:-1]
        before[local[:-1][full]] = OUT  # a block begins after a space, a row in no word
        out = EMIT[before, kind]
        for flag, sums in total.items():
            sums += _per_row((out & flag) != 0, local)
        last = local[1:][full]
        starts.append(at + np.flatnonzero(out & START))
        ends.append(at + np.sort(np.concatenate([np.flatnonzero(out & END), last[state[last - 1] == IN]])))
        at = cut
    start, end = np.concatenate(starts), np.concatenate(ends)
    row = np.searchsorted(offsets, start, side="right") - 1
    new = SpanTable(data, len(start)).first_of_each(start, end, row)
    return {
        "n_words": np.bincount(row, minlength=rows), "n_distinct": np.bincount(row[new], minlength=rows),
        "n_capitals": total[CAPITAL], "n_points": total[POINT], "n_symbols": total[MARK],
    }


def with_counts(docs: DataFrame, text: str = "text", symbols: bytes = b"#$%&*|", keep: list[str] | None = None) -> DataFrame:
    """Add n_words (runs of other than spaces, tabs and line ends), n_distinct (different ones), n_capitals (A-Z), n_points (code points) and
    n_symbols to every row, each over its whole text; columns in keep (default: all) stay. Null and empty texts have zeros."""
    kinds = byte_classes(symbols)

    def run(batch: pa.RecordBatch) -> list:
        return list(count_bytes(*bytes_of(batch.column(batch.schema.get_field_index(text))), kinds).values())

    return with_columns(docs, "n_words bigint, n_distinct bigint, n_capitals bigint, n_points bigint, n_symbols bigint", run, keep)
