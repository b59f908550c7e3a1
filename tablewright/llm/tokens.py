"""Words of whole texts as 64-bit hashes, found by array operations on the UTF-8 bytes.

A text column is cut into slices of bounded size (a longer text is a slice of its own), and
each slice gives the hashes of its words plus the number of words per text. Word bytes are
chosen by a table of 256 entries, so separators must be single bytes; A-Z is lowered. Two
different words share a hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 4 << 20  # of text handled at once
PIECE_BYTES = 1 << 20  # of bytes hashed at once
_BASE = U(0x9E6C63D0676A9A99 | 1)


def word_bytes(separators: str) -> np.ndarray:
    """Which byte values belong to words: all but those of the given single characters."""
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


#: Words are runs without white space.
PLAIN = word_bytes(" \t\n\x0b\x0c\r")
#: Words are runs of letters a-z, digits and anything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mix(left * U(0x9E3779B97F4A7C15) + mix(right + U(0x632BE59BD9B4E019)))


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            inverse = U(pow(int(_BASE), -1, 1 << 64))
            up, down = np.full(n, _BASE), np.full(n, inverse)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE_BYTES, "right")))
        high = int(ends[to - 1])
        up, down = _tables(max(PIECE_BYTES, high - low) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(high - low + 1, U)
            np.cumsum((data[low:high].astype(U) + U(1)) * up[: high - low], out=sums[1:])
            first, last = starts[at:to] - low, ends[at:to] - low
            value = (sums[last] - sums[first]) * down[first]
            out[at:to] = mix(value + (last - first).astype(U) * U(0xD6E8FEB86659FD93))
        at = to
    return out


@dataclass
class Words:
    """Words of several texts, one after the other."""

    first: int          #: row of the first text
    counts: np.ndarray  #: words per text
    hashes: np.ndarray  #: one per word
    data: np.ndarray    #: lowered bytes of the texts
    starts: np.ndarray  #: where each word begins in data
    ends: np.ndarray    #: where each word ends

    @property
    def bounds(self) -> np.ndarray:
        """Begin of each text among the words, and the end of the last."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    def strings(self, which: np.ndarray) -> list[bytes]:
        """The words at the given places."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its rows; null reads as empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[int(bounds[0]): int(bounds[-1])], bounds - bounds[0]


def words_of(texts: pa.Array, table: np.ndarray = PLAIN, slice_bytes: int = SLICE_BYTES, lower: bool = True) -> Iterator[Words]:
    """The words of each row, in slices of rows."""
    data, bounds = text_bytes(texts)
    row, n = 0, len(texts)
    while row < n:
        to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + slice_bytes, "right")) - 1)
        own = data[int(bounds[row]): int(bounds[to])]
        own = _LOWER[own] if lower else own
        offsets = bounds[row: to + 1] - bounds[row]
        inside = table[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[offsets] = True  # words do not run on into the next text
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before &= ~edge[:-1]
        after &= ~edge[1:]
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        counts = np.diff(np.searchsorted(starts, offsets))
        yield Words(row, counts, _hashes(own, starts, ends), own, starts, ends)
        row = to


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each place on; the last n - 1 places have none."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out = hashes[: len(hashes) - n + 1]
    for i in range(1, n):
        out = join_hash(out, hashes[i: len(hashes) - n + 1 + i])
    return out


def inside_one_text(counts: np.ndarray, n: int) -> np.ndarray:
    """For each word: whether n words of its own text begin there."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(len(ends)) + n <= ends
