"""SentencePiece model files: what the operators need of them, and how texts fall apart by them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

#: Kinds of pieces, the sign for a space, model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
UNIGRAM, BPE = 1, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i, value, shift = i + 1, value | (c & 127) << shift, shift + 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Field number, wire type and value, in order."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            size, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + size], i + size
        yield key >> 3, kind, value


def _field(number: int, kind: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    head = varint(number << 3 | kind)
    return head + (varint(value) if kind == 0 else (varint(len(value)) if kind == 2 else b"") + value)


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: int


@dataclass(frozen=True)
class Model:
    pieces: list[Piece]
    model_type: int
    byte_fallback: bool
    dummy_prefix: bool

    @property
    def bytes_at(self) -> list[int]:
        """Ids of the pieces that stand for single bytes."""
        at = {p.text: i for i, p in enumerate(self.pieces) if p.kind == BYTE}
        return [at[f"<0x{b:02X}>"] for b in range(256)]

    def chunks(self) -> re.Pattern:
        """Matches tile a normalised text so that no piece reaches over from one to the next.

        A space sign ends the chunk before it, and a line end stands alone, unless
        the vocabulary has pieces that reach over; then a text is one chunk.
        """
        normal = [p.text for p in self.pieces if p.kind == NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            return re.compile(r"(?s).+")
        if any("\n" in p for p in normal):
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def normalise(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)


def parse(data: bytes) -> Model:
    """The model of a file's bytes. Only identity normalisers, byte fallback and vocabularies without user-defined or unused pieces are supported."""
    pieces, trainer, normal = [], {}, {}
    for number, _, value in _fields(data):
        if number == 1:
            f = {n: v for n, _, v in _fields(value)}
            pieces.append(Piece(f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            trainer = {n: v for n, _, v in _fields(value)}
        elif number == 3:
            normal = {n: v for n, _, v in _fields(value)}
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or not trainer.get(35) or trainer.get(24):
        raise ValueError("the model must normalise by identity, keep spaces, mark them in front, and fall back to bytes")
    if {p.kind for p in pieces} & {USER_DEFINED, UNUSED}:
        raise ValueError("user-defined and unused pieces are not supported")
    return Model(pieces, trainer.get(3, UNIGRAM), True, bool(normal.get(3, 1)))


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def as_unigram(data: bytes, steps: int = 16) -> bytes:
    """The file's vocabulary as a unigram model: piece of rank r gets -log(r + 2), in steps of 1/``steps``.

    Zipf's rule over the file's own order; nothing is trained. Steps that are powers of
    two keep sums of scores exact.
    """
    import math

    out, rank = b"", 0
    for number, kind, value in _fields(data):
        if number == 1:
            f = {n: (k, v) for n, k, v in _fields(value)}
            if f.get(3, (0, NORMAL))[1] == NORMAL:
                f[2] = (5, struct.pack("<f", -round(steps * math.log(rank + 2)) / steps))
                rank += 1
            value = b"".join(_field(n, *f[n]) for n in sorted(f))
        elif number == 2:
            f = list(_fields(value))
            value = b"".join(_field(n, k, UNIGRAM if n == 3 else v) for n, k, v in f)
        out += _field(number, kind, value)
    return out
