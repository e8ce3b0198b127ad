"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text falls into chunks that no piece goes over. The distinct chunks of a run of texts that have equal
length advance together. Hashes of all their substrings of a size, at every place at once, are looked up
in the sorted keys of the pieces of that size (most are turned away before by a bit table). Then, at
each end position, one vectorised maximum over the sizes keeps the score and the size chosen (the
backpointer). Ties go to the longest last piece, as in the tokenizer.

Scores add up within a chunk, so that they don't lose digits over long texts. Every segmentation is
held against its chunk; one that doesn't spell it (a hash collision) is made again from the pieces
themselves. Tables cover CELLS places at a time, so that a chunk of any length takes bounded memory a
character and time in proportion to its length.

The model is read as unigram whatever its type (see _pieces.as_unigram): from a BPE file, ids are those
of the unigram search over its pieces and scores, not those of the file's own merges.

Defined results: a null text has no ids and decodes to an empty text, as an empty one does; repeated
rows are encoded one by one; characters without a piece become byte pieces, or else the unknown id,
once for a run of them, which can't be decoded back; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._common import Store, free_name, map_batches
from ._pieces import BYTE, SPACE, Pieces, default_path, pieces
from ._words import mix

#: Bytes of chunks and ids kept a process.
KEPT_BYTES = 64 << 20
#: Texts are coded in runs of about this many bytes; one longer text makes a run of its own.
RUN_BYTES = 4 << 20
#: Places of the tables of one advance.
CELLS = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The bit table of a size has 2^_SIEVE entries.
_SIEVE = 17


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


class Codec:
    def __init__(self, model: Pieces):
        self.model = model
        by_size: dict[int, list[str]] = {}
        for t in model.ids:
            by_size.setdefault(len(t), []).append(t)
        self.sizes, self.longest = sorted(by_size), max(by_size)
        self.keys, self.scores, self.ids, self.sieve = {}, {}, {}, {}
        for n, texts in by_size.items():
            points = np.array([[ord(c) for c in t] for t in texts], np.uint64)
            keys = self._prefixes(points.T)[n]
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces share a key")
            order = np.argsort(keys)
            self.keys[n] = keys[order]
            self.scores[n] = np.array([model.scores[t] for t in texts])[order]
            self.ids[n] = np.array([model.ids[t] for t in texts], np.int32)[order]
            self.sieve[n] = np.zeros(1 << _SIEVE, bool)
            self.sieve[n][keys >> np.uint64(64 - _SIEVE)] = True
        points = [[ord(c) for c in t] for t in model.text]
        self.points = np.array([c for p in points for c in p], np.uint32)
        self.points_at = np.cumsum([0] + [len(p) for p in points])
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() for t, k in zip(model.text, model.kind)]
        self.kept = Store(KEPT_BYTES)

    @staticmethod
    def _prefixes(points: np.ndarray) -> np.ndarray:
        """Sums of code points times powers of the base, a row a place, one more than ``points`` has. The key of places a to b is their difference over the power of a."""
        out = np.zeros((points.shape[0] + 1, points.shape[1]), np.uint64)
        np.cumsum(mix(points + np.uint64(1)) * _powers(_BASE, points.shape[0])[:-1, None], axis=0, out=out[1:])
        return out

    def _advance(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of equal length. All tables have a row a place and a column a text."""
        n, rows, most = len(texts[0]), len(texts), self.longest
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(rows, n)
        prefix, back = self._prefixes(codes.T.astype(np.uint64)), _powers(_BACK, n)
        best = np.full((n + 1 + most, rows), -np.inf)  # place p is in row p + most
        best[most] = 0
        size, piece = np.zeros((n + 1, rows), np.int32), np.full((n + 1, rows), -2, np.int32)
        step, columns = max(1, CELLS // rows), np.arange(rows)
        for low in range(1, n + 1, step):
            high = min(low + step, n + 1)  # ends low to high - 1
            score = np.full((high - low, most, rows), -np.inf)  # longest first: the first of equal maxima wins
            found = np.full((high - low, most, rows), -2, np.int32)
            for s in self.sizes:
                first = max(low, s)
                if first >= high:
                    break
                key = ((prefix[first:high] - prefix[first - s : high - s]) * back[first - s : high - s, None]).ravel()
                at = np.flatnonzero(self.sieve[s][key >> np.uint64(64 - _SIEVE)])
                key = key[at]
                place = np.minimum(np.searchsorted(self.keys[s], key), len(self.keys[s]) - 1)
                hit = self.keys[s][place] == key
                at, place = at[hit] + (first - low) * rows, place[hit]
                score[at // rows, most - s, at % rows] = self.scores[s][place]
                found[at // rows, most - s, at % rows] = self.ids[s][place]
            single = score[:, most - 1]
            single[np.isneginf(single)] = self.model.unk_score
            for end in range(low, high):
                total = best[end : end + most] + score[end - low]
                chosen = total.argmax(0)
                best[end + most] = total[chosen, columns]
                size[end] = most - chosen
                piece[end] = found[end - low, chosen, columns]
        return self._trace(texts, codes, size, piece)

    def _trace(self, texts: list[str], codes: np.ndarray, size: np.ndarray, piece: np.ndarray) -> list[bytes]:
        rows, n = codes.shape
        row, end = np.arange(rows), np.full(rows, n)
        steps: list[tuple[np.ndarray, ...]] = []
        while len(row):
            own = size[end, row]
            steps.append((row, end - own, own, piece[end, row]))
            end = end - own
            row, end = row[end > 0], end[end > 0]
        row, start, own, ids = (np.concatenate([s[k] for s in reversed(steps)]) for k in range(4))
        order = np.argsort(row, kind="stable")  # a row's pieces stand in their order already
        row, start, own, ids = row[order], start[order], own[order], ids[order]
        known = ids >= 0
        at = np.repeat(row * n + start, own) + (np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own))
        spelt = np.repeat(self.points_at[np.maximum(ids, 0)], own) + (at - np.repeat(row * n + start, own))
        wrong = (codes.ravel()[at] != self.points[np.minimum(spelt, len(self.points) - 1)]) & np.repeat(known, own)
        odd = set(row[~known].tolist())
        again = set((at[wrong] // n).tolist())
        raw, ends = ids.astype("<i4").tobytes(), (np.searchsorted(row, np.arange(rows + 1)) * 4).tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:])]
        for k in odd - again:
            a, b = ends[k] // 4, ends[k + 1] // 4
            out[k] = self._ids(texts[k], list(zip(ids[a:b].tolist(), start[a:b].tolist(), (start[a:b] + own[a:b]).tolist())))
        for k in again:
            out[k] = self._ids(texts[k], self._plain(texts[k]))
        return out

    def _plain(self, text: str) -> list[tuple[int, int, int]]:
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, len(text) + 1):
            top = (-np.inf, 0, -2)
            for size in reversed(self.sizes):
                if size <= end and ((part := text[end - size : end]) in self.model.ids or size == 1):
                    score = best[end - size][0] + self.model.scores.get(part, self.model.unk_score)
                    if score > top[0]:
                        top = (score, size, self.model.ids.get(part, -2))
            best.append(top)
        end, path = len(text), []
        while end:
            path.append((best[end][2], end - best[end][1], end))
            end -= best[end][1]
        return path[::-1]

    def _ids(self, text: str, path: list[tuple[int, int, int]]) -> bytes:
        out, last = [], None
        for i, a, b in path:
            if i != -2:
                out.append(i)
            elif self.model.byte_ids is not None:
                out += [self.model.byte_ids[c] for c in text[a:b].encode("utf-8", "replace")]
            elif last != -2:
                out.append(self.model.unk_id)
            last = i
        return np.array(out, "<i4").tobytes()

    def _make(self, chunks: list[str]) -> dict[str, bytes]:
        by_size: dict[int, list[str]] = {}
        for c in chunks:
            by_size.setdefault(len(c), []).append(c)
        made: dict[str, bytes] = {}
        for n, group in by_size.items():
            step = max(1, CELLS // n)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                made.update(zip(part, self._advance(part)))
        return made

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chunks: list[str] = []
        ends = [0]
        for t in texts:
            chunks += self.model.chunks(t)
            ends.append(len(chunks))
        coded = pa.array(chunks, pa.large_string()).dictionary_encode()
        each = self.kept.look(coded.dictionary.to_pylist(), self._make)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        code = coded.indices.to_numpy()
        n = size[code]
        at = np.cumsum(n)
        total = int(at[-1]) if len(at) else 0
        place = np.arange(total) + np.repeat((np.cumsum(size) - size)[code] - (at - n), n)
        return np.frombuffer(b"".join(each), "<i4")[place], np.concatenate([[0], at])[ends]

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: (first text, ids, bounds); ids[bounds[k]:bounds[k + 1]] are the ids of text first + k."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + RUN_BYTES, "right")) - 1)
            yield first, *self._run(column.slice(first, last - first).to_pylist())
            first = last

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [ids[a:b].astype("<i4").tobytes() for _, ids, bounds in self.runs(pa.array(texts, pa.large_string())) for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces in a row, byte pieces as bytes, without the space put in front."""
        text = b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a process and file."""
    return Codec(pieces(path))


def encode(docs: DataFrame, path: str | None = None, output: str = "ids") -> DataFrame:
    """``docs`` with a column ``output`` of ids (array of int)."""
    path = path or default_path()
    taken = docs.columns
    name, at = free_name(taken, output), taken.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` array<int>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, ids, bounds in codec(path).runs(batch.column(at)):
            flat.append(ids)
            ends.append(bounds[1:] + ends[-1][-1])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(flat)))], [*taken, name])

    return map_batches(docs, run, schema)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, output: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids."""
    path = path or default_path()
    taken = rows.columns
    name, at = free_name(taken, output), taken.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.decode(np.array(x or [], np.int64)) for x in batch.column(at).to_pylist()], pa.string())], [*taken, name])

    return map_batches(rows, run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's ids as count and CRC-32, and whether they decode to its text."""
    path = default_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, texts, n, crc, same = codec(path), batch.column(1).to_pylist(), [], [], []
        for first, ids, bounds in own.runs(batch.column(1)):
            for text, a, b in zip(texts[first:], bounds.tolist(), bounds[1:].tolist()):
                n.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
                same.append(own.decode(ids[a:b]) == (text or ""))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return map_batches(docs, run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
