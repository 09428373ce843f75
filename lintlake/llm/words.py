"""Words of whole batches of texts as 64-bit hashes, and window minimizers over them, with numpy.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, as `bytes.split()` cuts UTF-8. Batches are taken
as one array of bytes, so the cost of a call is spread over many texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 20

_POSITION_BITS = 24
#: Windows that are looked at together; positions must fit beside hashes.
_STRETCH = 1 << 22

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: Added to a value by its place before both are mixed: without the mixing between, long words or runs of words could
#: be built that share a sum.
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass
class Words:
    """The words of some texts: where each begins and ends in `data`, whose text it is, and its hash."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first_of_row: np.ndarray  # of each text the number of its first word; one more entry at the end

    def joined(self, first: int, end: int) -> bytes:
        """Words first to end - 1, one space between them."""
        return b" ".join(self.data[self.begin[first] : self.end[end - 1]].tobytes().split())


def chunks(column: pa.StringArray):
    """Yield (first row, Words) for runs of rows of a column without nulls."""
    n = len(column)
    if not n:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, _words(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        at = stop


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.append(False, inside[:-1]) if len(data) else inside
    begin = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~np.append(inside[1:], False) | cut[1:])) + 1 if len(data) else begin
    size = end - begin
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    start = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(start, size)
    sums = np.add.reduceat(mixed(_OF_BYTE[data[inside]] + within.astype(np.uint64) * _PLACE), start)
    first_of_row = np.searchsorted(begin, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first_of_row))
    return Words(data, begin, end, row, mixed(sums + size.astype(np.uint64)), first_of_row)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, also across texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, place in enumerate(np.arange(k, dtype=np.uint64) * _PLACE):
        out += mixed(hashes[i : i + n] + place)
    return mixed(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n]) if size < width else x[:n]


def anchors(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): runs of windows, by the number of their first word, that share their anchor, the
    leftmost least k-gram hash in them. Each window of `window` words of a text is in one run; windows with equal
    words have equal anchors."""
    g = grams(w.hash, k)
    n = len(w.hash) - window + 1
    out = []
    for at in range(0, max(n, 0), _STRETCH):
        part = g[at : min(n, at + _STRETCH) + window - k]
        packed = (part >> np.uint64(_POSITION_BITS)) << np.uint64(_POSITION_BITS) | np.arange(len(part), dtype=np.uint64)
        place = (_sliding_min(packed, window - k + 1) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        whole = w.row[at : at + len(place)] == w.row[at + window - 1 : at + window - 1 + len(place)]
        place[~whole] = -1  # these windows reach into the next text
        first = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        last = np.append(first[1:] - 1, len(place) - 1)
        real = place[first] >= 0
        first, last = first[real], last[real]
        out.append((part[place[first]], first + at, last + at))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def digest_of(words: bytes) -> int:
    """64 bits of a run of words, joined."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
