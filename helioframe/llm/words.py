"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column.

A word's hash is a sum of mixed groups of eight bytes, each mixed with its place,
which leaves no algebra by which different words could agree. A run's hash is a
polynomial over word hashes, taken as a difference of prefix sums, so any run
costs the same. Lanes are independent from the bytes on. Hashes depend only on
the words, never on the machine, partition or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers for groups of bytes in a word and words in a run.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Texts are worked on in pieces of about so many bytes and at most so many rows;
#: a longer text is a piece of its own, never divided.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 60_000

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A word's bytes: anything but white space.
DENSE = ~SPACES
#: A word's bytes: ASCII letters and digits, and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, PIECE_BYTES + 1), base, U)
        found[0] = 1
        found = np.cumprod(found)
        if len(found) <= 4 * PIECE_BYTES:
            _POWERS[base] = found
    return found[:n]


class Runs:
    """Hashes of runs of a sequence of 64-bit numbers, each at the same price."""

    def __init__(self, numbers: np.ndarray, base: int):
        n = len(numbers)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(numbers * powers(base, n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class Words:
    """`first[i]:first[i + 1]` are the words of text i; `start` and `end` their bytes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, dense: np.ndarray):
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1
        inside = dense[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        turn = edge.copy()
        turn[1:-1] |= inside[1:] != inside[:-1]
        places = np.flatnonzero(turn)
        opens = inside[places[:-1]] if len(data) else np.zeros(0, bool)
        self.start, self.end = places[:-1][opens], places[1:][opens]
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n), self.counts)
        self._runs: dict[int, Runs] = {}

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of every word; lanes are independent."""
        if not len(self.start):
            return np.zeros(0, U)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        length = self.end - self.start
        groups = (length + 7) >> 3
        first = np.cumsum(groups) - groups
        place = np.arange(groups.sum()) - np.repeat(first, groups)
        at = np.repeat(self.start, groups) + 8 * place
        left = np.minimum(np.repeat(self.end, groups) - at, 8).astype(U)
        value = eights[at] & (U((1 << 64) - 1) >> (U(64) - (left << U(3))))
        seed = mix(np.array([lane + 1], U) * U(WORD_BASE))
        mixed = mix(value ^ mix(place.astype(U) * U(BYTE_BASE) + seed))
        return mix(np.add.reduceat(mixed, first) + length.astype(U) * U(WORD_BASE) + seed)

    def runs(self, lane: int = 0) -> Runs:
        """Hashes of runs of words; another lane gives independent ones."""
        if lane not in self._runs:
            self._runs[lane] = Runs(self.hashes(lane), WORD_BASE)
        return self._runs[lane]

    def windows(self, size: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and one past the last of every run of `size` words of one text.

        With `whole`, a text of fewer words, but not none, is one run.
        """
        starts = np.arange(max(0, len(self.start) - size + 1))
        starts = starts[self.text[starts] == self.text[starts + size - 1]] if len(starts) else starts
        ends = starts + size
        if whole:
            short = np.flatnonzero((self.counts > 0) & (self.counts < size))
            starts = np.concatenate([starts, self.first[short]])
            ends = np.concatenate([ends, self.first[short + 1]])
        return starts, ends

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def by_text(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An order by text, then value; texts are numbered below 2^16."""
    order = np.argsort(values)
    return order[np.argsort(text[order].astype(np.uint16), kind="stable")]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def pieces(column: pa.Array, dense: np.ndarray = DENSE, lower: bool = False,
           ) -> Iterator[tuple[int, int, Words]]:
    """The words of a column of whole texts, as pieces (from row, to row, Words)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    octets = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
        to = min(max(to, at + 1), at + PIECE_ROWS, n)
        piece = octets[offsets[at]:offsets[to]]
        yield at, to, Words(LOWER[piece] if lower else piece, offsets[at:to + 1] - offsets[at], dense)
        at = to
