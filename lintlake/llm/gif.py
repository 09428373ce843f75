"""GIF: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

`decode_gif` reads any GIF87a/89a file: global and local palettes, interlaced frames, graphic control
extensions (delay, disposal, transparent index), and composes each frame on the logical screen.
`encode_gif` writes 8-bit frames with a real LZW dictionary, so payloads are stored without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import renamed, slices, table, with_fields, written

WIDTH = 192
#: Rows of a frame at most; a longer payload has several frames.
FRAME_ROWS = 512
DELAY_CS = 10
MAX_CODES = 4096
#: Pixels of a screen or frame at most (64 MB with four channels); a header that asks for more is an error.
MAX_PIXELS = 1 << 24


class GifError(ValueError):
    """The bytes are no GIF that can be decoded."""


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int  # -1: none
    indices: np.ndarray  # height x width
    screen: np.ndarray  # height x width x 4 of the logical screen once this frame is drawn


# ---- LZW ----


def _widths(n: int, first: int, decoder_lag: int) -> np.ndarray:
    """Bits of each of n codes that follow a clear code, with `first` the first free code."""
    top = first + np.arange(n) - decoder_lag
    return np.minimum(12, np.maximum(first.bit_length() - 1 if first & (first - 1) else first.bit_length(), np.floor(np.log2(np.maximum(top, 1))).astype(np.int64) + 1))


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """LZW code stream of `data`, one byte a sample; codes have min_bits + 1 to 12 bits, lowest bit first."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    find, free = table.get, end + 1
    it = iter(data)
    word = next(it, None)
    if word is not None:
        for b in it:
            key = word << 8 | b
            code = find(key)
            if code is not None:
                word = code
                continue
            codes.append(word)
            if free < MAX_CODES:
                table[key] = free
                free += 1
            else:  # the dictionary is full: start anew
                runs.append(codes)
                codes = []
                table.clear()
                free = end + 1
            word = b
        codes.append(word)
    runs.append(codes)
    values, bits = [], []
    width, carry = min_bits + 1, min_bits + 1  # a clear code has the width that the run before it ended with
    for k, run in enumerate(runs):
        last = k == len(runs) - 1
        w = _widths(len(run) + 1, end + 1, 1)
        w[0] = min_bits + 1
        values.append(np.array([clear, *run, *([end] if last else [])], np.int64))
        bits.append(np.concatenate([[carry], w[: len(run)], w[len(run) :] if last else []]).astype(np.int64))
        carry = int(w[len(run)])
    return _packed(np.concatenate(values), np.concatenate(bits))


def _packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    ends = np.cumsum(bits)
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, np.uint32)
    start = ends - bits
    shifted = (values << (start & 7)).astype(np.int64)
    at = start >> 3
    for k in range(3):  # 12 bits from a byte's seventh bit on reach over three bytes; bits never meet, so sums are ors
        out += np.bincount(at + k, ((shifted >> (8 * k)) & 255), len(out)).astype(np.uint32)
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


_LAYOUT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and first bits of as many codes after a clear code as fill the dictionary."""
    if min_bits not in _LAYOUT:
        first = (1 << min_bits) + 2
        n = MAX_CODES - first + 1
        w = _widths(n, first, 1)
        w[0] = min_bits + 1
        _LAYOUT[min_bits] = (w, np.cumsum(w) - w)
    return _LAYOUT[min_bits]


def _strings(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples that the codes after one clear code stand for.

    Entry k is the string of the k-th code and the sample that follows it, so it lies in the output where
    the k-th code's string begins. Each sample of a later code points there; pointers are doubled until
    they rest at a literal.
    """
    n = len(codes)
    entry = codes - (clear + 2)
    literal = codes < clear
    place = np.arange(n)
    if np.any((entry >= place) & ~literal):
        raise GifError("a code beyond the dictionary")
    parent = np.where(literal, place, entry)
    length = np.where(literal, 1, 2)  # one more than the parent's, which is a literal's so far
    while not np.array_equal(up := parent[parent], parent):
        length = length + length[parent] - 1
        parent = up
    starts = np.cumsum(length) - length
    owner = np.repeat(place, length)
    at = np.arange(len(owner))
    source = np.where(literal[owner], at, starts[np.where(literal, place, entry)][owner] + at - starts[owner])
    while not np.array_equal(up := source[source], source):
        source = up
    return codes[owner[source]].astype(np.uint8)


def lzw_decode(stream: bytes, min_bits: int, samples: int) -> bytes:
    """The first `samples` samples of a code stream. Codes after a full dictionary keep 12 bits until a clear
    code and enter nothing."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    padded = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    whole = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    total = 8 * len(stream)
    widths, places = _layout(min_bits)
    out: list[np.ndarray] = []
    got, bit, over = 0, 0, False
    while got < samples and not over:
        run: list[np.ndarray] = []
        begin, w, p = bit, widths, places
        while True:  # the codes up to the next clear or end code
            n = int(np.searchsorted(begin + p + w, total, "right"))
            at, w = begin + p[:n], w[:n]
            codes = whole[at >> 3] >> (at & 7) & ((1 << w) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            m = int(stop[0]) if len(stop) else n
            run.append(codes[:m])
            if m < n:
                bit, over = int(at[m] + w[m]), int(codes[m]) == end
                break
            if n < len(p) or not n:
                over = True
                break
            begin, p, w = int(at[-1] + w[-1]), 12 * np.arange(4096), np.full(4096, 12)
        if sum(map(len, run)):
            out.append(_strings(np.concatenate(run), clear))
            got += len(out[-1])
    if got < samples:
        raise GifError(f"{got} of {samples} samples")
    return np.concatenate(out)[:samples].tobytes() if samples else b""


# ---- container ----


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[np.ndarray], palette: np.ndarray, delay_cs: int = DELAY_CS, disposal: int = 1) -> bytes:
    """A GIF89a of index arrays (height x width, uint8) with one palette of 256 colours."""
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2, delay_cs, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0), b"\x08", _blocks(lzw_encode(f.tobytes()))]
    return b"".join([*out, b"\x3b"])


def _interlaced_rows(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes, compose: bool = True) -> list[Frame]:
    """Frames in order. `compose=False` leaves out the screens."""
    return list(frames_of(data, compose))


def frames_of(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """Frames of `decode_gif` one by one, so that only one screen need be held."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    try:
        yield from _decoded(data, compose)
    except (IndexError, struct.error) as e:
        raise GifError("the file ends early") from e


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    if at + n > len(data):
        raise GifError("the file ends in a palette")
    colours = np.zeros((256, 3), np.uint8)
    colours[: n // 3] = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
    return colours, at + n


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _decoded(data: bytes, compose: bool) -> Iterator[Frame]:
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > MAX_PIXELS:
        raise GifError("the screen is too large")
    shared, at = _palette(data, 13, flags)
    screen = np.zeros((height, width, 4), np.uint8) if compose else None
    delay, disposal, transparent = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            block, at = _sub_blocks(data, at + 2)
            if kind == 0xF9:
                f, delay, t = struct.unpack("<BHB", block[:4])
                disposal, transparent = f >> 2 & 7, t if f & 1 else -1
            continue
        if data[at] != 0x2C:
            raise GifError("an unknown block")
        left, top, w, h, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        own, at = _palette(data, at + 10, f)
        min_bits = data[at]
        if not 2 <= min_bits <= 8:
            raise GifError("code size")
        if w * h > MAX_PIXELS:
            raise GifError("a frame is too large")
        stream, at = _sub_blocks(data, at + 1)
        indices = np.frombuffer(lzw_decode(stream, min_bits, w * h), np.uint8).reshape(h, w)
        if f & 0x40:
            straight = np.empty_like(indices)
            straight[_interlaced_rows(h)] = indices
            indices = straight
        shown = None
        if compose:
            colours = own if own is not None else shared if shared is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
            before = screen.copy() if disposal == 3 else None
            area = screen[top : top + h, left : left + w]
            part = indices[: area.shape[0], : area.shape[1]]
            drawn = part != transparent
            area[drawn] = np.concatenate([colours[part[drawn]], np.full((int(drawn.sum()), 1), 255, np.uint8)], 1)
            shown = screen.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                screen = before
        yield Frame(left, top, w, h, delay, disposal, transparent, indices, shown)
        delay, disposal, transparent = 0, 0, -1


def colour_histogram(screen: np.ndarray, levels: int = 4) -> np.ndarray:
    """Counts of opaque pixels in levels ** 3 cells of red, green and blue, and of the others last."""
    q = screen.reshape(-1, 4)
    level = (np.arange(256) * levels // 256).astype(np.int32)
    cell = (level[q[:, 0]] * levels + level[q[:, 1]]) * levels + level[q[:, 2]]
    return np.bincount(np.where(q[:, 3] > 0, cell, levels**3), minlength=levels**3 + 1)


# ---- tables ----


GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def payload_gif(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_gif([rows[i : i + FRAME_ROWS] for i in range(0, len(rows), FRAME_ROWS)], GREYS)


def texts_to_gifs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a GIF, a byte a sample, in frames of 192 columns. Null is empty;
    nulls and repeats of doc_id stay; a text of any length has as many frames as it takes; other columns are not read."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                both = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([payload_gif(p) for _, p in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, with_fields([renamed(docs, doc_id, "doc_id")], n_bytes=T.LongType(), media=T.BinaryType())
    )


def gif_frames(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """One row a frame: its time, place, rules and the colour histogram of the screen it leaves. A file that
    isn't a GIF, and a null, give one row with `error` set."""
    rest = T.StructType.fromDDL("frame int, start_cs long, delay_cs int, left int, top int, width int, height int, disposal int, transparent int, histogram array<long>, error string")
    schema = with_fields([renamed(media, key, "key"), *rest])
    names = schema.names
    types = [None, pa.int32(), pa.int64(), *[pa.int32()] * 7, pa.list_(pa.int64()), pa.string()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for k, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        start, shown = 0, []
                        for i, f in enumerate(frames_of(data or b"")):
                            shown.append((k, i, start, f.delay_cs, f.left, f.top, f.width, f.height, f.disposal, f.transparent, colour_histogram(f.screen).tolist(), None))
                            start += f.delay_cs
                        rows += shown
                    except GifError as e:
                        rows.append((k, *[None] * 10, str(e)))
                yield pa.record_batch([pa.array(c, t or part.schema.field(0).type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)

    return media.select(F.col(key).alias("key"), F.col(column).alias("media")).mapInArrow(run, schema)


def stored_features(media: DataFrame) -> DataFrame:
    """Reads the stored GIFs of `texts_to_gifs` back: digests of the payload and of the file, and, added up over the
    frames, the colour histograms of the composed screens with the frames and the hundredths of a second they take."""
    rest = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_cs long"
    schema = with_fields([media.schema["doc_id"], *T.StructType.fromDDL(rest)])
    names = schema.names

    def features(n_bytes: int, data: bytes) -> tuple:
        payload, size, tail, colours, n, time = hashlib.sha256(), 0, b"", np.zeros(4**3 + 1, np.int64), 0, 0
        for f in frames_of(data):
            samples = f.indices.tobytes()
            payload.update(samples)
            size, tail, colours, n, time = size + len(samples), (tail + samples[-16:])[-16:], colours + colour_histogram(f.screen), n + 1, time + f.delay_cs
        return (
            n_bytes, size, payload.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, colours.tolist())), n, time,
        )

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                rows = [features(n, d) for n, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(written(texts_to_gifs(table(spark, sf_dir, "documents")), "gifs"))
