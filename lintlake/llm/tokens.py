"""Byte-level BPE ids of whole texts, with a bounded cache of pieces.

A piece is a run of text that starts at a single space between two non-space characters. The pattern
that cuts texts into words always cuts there, so pieces are encoded independently of each other, and
the ids of a text are those of its pieces, one after the other. Ids equal those of the tokenizers
library (tests hold both against each other).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

try:
    import public_tokenizers

    DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
    WORD_PATTERN = public_tokenizers.PATTERN
except ImportError:  # the path is then the caller's to give
    DEFAULT_TOKENIZER, WORD_PATTERN = None, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NEXT_TO_SPACE = [x for c in " \n\t\r\x0b\x0c" for x in (f" {c}", f"{c} ")]
_RARE_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUTS = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> tuple[str, list[str]]:
    """(first piece, further pieces without their leading space)."""
    if not any(x in text for x in _NEXT_TO_SPACE) and (text.isascii() or not _RARE_SPACES.search(text)):
        first, *rest = text.split(" ")
        if not rest or rest[-1]:
            return first, rest
    first, *rest = _CUTS.split(text)
    return first, [p[1:] for p in rest]


class PieceCache:
    """Ids of pieces, bounded in bytes: when full it starts anew. Long pieces are not kept."""

    #: Letters of a piece that is kept, what an entry costs beside its letters and ids, and bytes of a full cache.
    LETTERS, ENTRY, FULL = 64, 200, 64 << 20

    def __init__(self, full: int | None = None):
        self.ids: dict[str, bytes] = {}
        self.bytes, self.full = 0, full or self.FULL

    def update(self, new: dict[str, bytes]) -> None:
        kept = {p: ids for p, ids in new.items() if len(p) <= self.LETTERS}
        self.bytes += sum(self.ENTRY + len(p) + len(ids) for p, ids in kept.items())
        if self.bytes > self.full:
            self.ids.clear()
            self.bytes = 0
        else:
            self.ids.update(kept)


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(letters[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        self.merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.letters = letters
        self.bytes_of: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit bytes, from a cache of pieces."""

    def __init__(self, path: str, full: int | None = None):
        import tiktoken

        v = vocabulary(path)
        if len(v.bytes_of) > 65_536:
            raise ValueError("ids over 65535 don't fit the cache")
        self.bpe = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)
        self.lengths = np.array([len(b) for b in v.bytes_of], np.int64)
        self.cache = PieceCache(full)

    def _plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), "<u2").tobytes()

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """Encode new pieces many at a time; where each ends follows from the byte lengths of the ids."""
        out = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self.bpe.encode(" " + " ".join(part), allowed_special="all"), "<u2")
            ends = np.cumsum(self.lengths[ids])
            want = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in part), np.int64, len(part)))
            stops = np.searchsorted(ends, want) + 1
            raw, begin = ids.tobytes(), 0
            for w, stop in zip(part, stops.tolist(), strict=True):
                out[w] = raw[2 * begin : 2 * stop]
                begin = stop
        return out

    def batch(self, texts: list[str | None]):
        """Yield each text's ids as bytes; a null text has none. Callers bound the texts' bytes."""
        cut = [pieces(t or "") for t in texts]
        wanted = {p for _, rest in cut for p in rest}
        known = {p: ids for p in wanted if (ids := self.cache.ids.get(p)) is not None}
        new = self._encoded(list(wanted - known.keys()))
        self.cache.update(new)
        ids_of = (known | new).__getitem__
        for first, rest in cut:
            yield (self._plain(first) if first else b"") + b"".join(map(ids_of, rest))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker; it stays between tasks."""
    return Encoder(path)
