"""Reading SentencePiece model files: pieces, scores and the flags that bear on segmentation."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_PENALTY = 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes, int, int]]:
    """(number, value, start, end) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value, start, at


def _write_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


#: Scores at or below this stand for "never merged" in BPE files.
NEVER = -1e8


def as_unigram(model: bytes) -> bytes:
    """The model as a unigram one; a model that is unigram already comes back unchanged.

    A BPE file's pieces and scores are kept and read as log-probabilities, and its type is set. Only its
    NEVER scores become one less than the lowest other one: as they are, single-precision sums of the
    tokenizer would lose all other scores beside them.
    """
    fields = list(_fields(model))
    trainer = next((dict((n, v) for n, v, _, _ in _fields(value)) for number, value, _, _ in fields if number == 2), {})
    if trainer.get(3, 1) == 1:
        return model
    score = lambda v: next((struct.unpack("<f", w)[0] for n, w, _, _ in _fields(v) if n == 2), 0.0)
    floor = min(s for number, value, _, _ in fields if number == 1 and (s := score(value)) > NEVER) - 1
    out = []
    for number, value, start, end in fields:
        if number == 2:
            value = b"".join(value[a:b] for n, _, a, b in _fields(value) if n != 3) + b"\x18\x01"
        elif number == 1 and score(value) <= NEVER:
            value = b"".join(value[a:b] for n, _, a, b in _fields(value) if n != 2) + b"\x15" + struct.pack("<f", floor)
        else:
            out.append(model[start:end])
            continue
        out.append(bytes([number << 3 | 2]) + _write_varint(len(value)) + value)
    return b"".join(out)


@dataclass
class Pieces:
    """A unigram model. ``scores`` has the pieces that may be matched in a text."""

    text: list[str]
    kind: list[int]
    scores: dict[str, float]
    ids: dict[str, int]
    unk_id: int
    unk_score: float
    byte_ids: list[int] | None
    dummy_prefix: bool
    squeeze: bool
    chunk: re.Pattern = field(repr=False)

    @staticmethod
    def parse(model: bytes) -> Pieces:
        text, kind, score = [], [], []
        byte_fallback, dummy, squeeze, escape, charsmap = False, True, True, True, b""
        for number, value, _, _ in _fields(model):
            if number == 1:
                f = {n: v for n, v, _, _ in _fields(value)}
                text.append(f[1].decode("utf-8"))
                score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kind.append(f.get(3, NORMAL))
            elif number == 2:
                byte_fallback = bool({n: v for n, v, _, _ in _fields(value)}.get(35, 0))
            elif number == 3:
                f = {n: v for n, v, _, _ in _fields(value)}
                charsmap, dummy, squeeze, escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if charsmap or not escape or USER_DEFINED in kind:
            raise ValueError("only models with identity normalisation, escaped spaces and no user-defined pieces are read")
        scores = {t: s for t, s, k in zip(text, score, kind) if k == NORMAL}
        ids = {t: i for i, (t, k) in enumerate(zip(text, kind)) if k == NORMAL}
        where = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(text, kind)) if k == BYTE}
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in ids):
            raise ValueError("a piece goes over a word's end")
        alone = "\n" if not any("\n" in t and len(t) > 1 for t in ids) else ""
        chunk = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else ""))
        return Pieces(text, kind, scores, ids, kind.index(UNKNOWN), min(scores.values()) - UNK_PENALTY, [where[b] for b in range(256)] if byte_fallback else None, dummy, squeeze, chunk)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that no piece goes over; segmenting them one by one is segmenting the text."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return self.chunk.findall(SPACE + text if self.dummy_prefix else text)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces.parse(as_unigram(f.read()))


def default_path() -> str:
    """The public piece vocabulary, where the tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
