"""Token ids of whole texts by a tokenizers file, with the ids of recurring words kept.

Where the pre-tokenizer drops white space and the normaliser acts within words (as in a BPE with word
ends), a text's ids are those of its white-space separated chunks one after another. ``WordEncoder``
relies on this; ``by_words`` tells from the file whether it holds, and otherwise texts go whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ._common import Store

#: Bytes of words and ids kept a process; what is kept beyond goes, but for the words of the run at hand.
KEPT_BYTES = 96 << 20
#: Texts are coded in runs of about this many bytes, which bound the memory; one longer text makes a run of its own.
RUN_BYTES = 8 << 20
#: Words of letters that are coded in one text.
TOGETHER = 4096
#: A full stop or comma after a letter or digit and before white space is a token of its own.
_STOPS = r"([A-Za-z0-9])([.,])([ \t\n\r]|$)"


class WordEncoder:
    """``runs(column)``: the ids of the texts of a column, special tokens not added."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = self._splits_at_white_space(spec)
        self.lowers = self.by_words and any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.ends = None
        if self.by_words and suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kept = Store(KEPT_BYTES)

    @staticmethod
    def _splits_at_white_space(spec: dict) -> bool:
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norm = {n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])}
        split = [p for p in parts if p["type"] == "Split"]
        return bool(split) and split[0]["behavior"] == "Removed" and split[0]["invert"] and r"[^\s\p{L}\p{N}]+" in split[0]["pattern"].get("Regex", "") and norm <= {"NFC", "Replace", "Lowercase"} and not any(p.get("add_prefix_space") for p in parts)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _words(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct chunks. Words of letters alone have one token with a word's end, so they are encoded in one text and told apart by it."""
        made: dict[bytes, bytes] = {}
        if self.ends is not None:
            letters = [c for c in chunks if c.isalpha() or c.decode("utf-8", "replace").isalpha()]
            for k in range(0, len(letters), TOGETHER):
                plain = letters[k : k + TOGETHER]
                ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(plain):
                    raw, at = ids.tobytes(), [0, *(stops * 4).tolist()]
                    made.update((c, raw[a:b]) for c, a, b in zip(plain, at, at[1:]))
        rest = [c for c in chunks if c not in made]
        if rest:
            made.update(zip(rest, self._encode(rest)))
        return made

    def _chunked(self, texts: pa.Array) -> pa.ListArray:
        """Chunks whose ids in a row are those of the text. The fewer there are that differ, the more of them are kept."""
        if self.lowers:
            # A-Z are lower-cased anyway; a special token is matched before that, so texts that may hold one stay.
            marked = pc.match_substring(texts, "<|")
            for word in self.special:
                marked = pc.or_(marked, pc.match_substring(texts, word))
            plain = pc.replace_substring_regex(pc.ascii_lower(texts), _STOPS, r"\1 \2\3")
            texts = pc.if_else(marked, texts, plain)
        return pc.ascii_split_whitespace(texts)

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            coded = self._encode([t.encode() for t in texts.to_pylist()])
            return np.frombuffer(b"".join(coded), "<u4"), np.cumsum([0] + [len(x) // 4 for x in coded])
        chunks = self._chunked(texts)
        coded = chunks.flatten().dictionary_encode()
        each = self.kept.look(coded.dictionary.cast(pa.large_binary()).to_pylist(), self._words)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        code = coded.indices.to_numpy()
        n = size[code]
        at = np.cumsum(n)
        total = int(at[-1]) if len(at) else 0
        place = np.arange(total) + np.repeat((np.cumsum(size) - size)[code] - (at - n), n)
        ids = np.frombuffer(b"".join(each), "<u4")[place]
        return ids, np.concatenate([[0], at])[chunks.offsets.to_numpy()]

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: (first text, ids, bounds); ids[bounds[k]:bounds[k + 1]] are the little-endian unsigned 32-bit ids of text first + k. A null has none."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + RUN_BYTES, "right")) - 1)
            yield first, *self._run(column.slice(first, last - first))
            first = last

    def ids(self, data: bytes | None) -> bytes:
        """The ids of one UTF-8 text, as bytes."""
        return b"".join(ids.tobytes() for _, ids, _ in self.runs(pa.array([(data or b"").decode("utf-8", "replace")])))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def default_path() -> str:
    """The public word BPE, where the tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
