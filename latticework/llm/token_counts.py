"""Token counts without the tokens: Viterbi that carries a score and a count.

An Aho-Corasick automaton of the vocabulary gives, in one pass over a chunk of text, every piece that
ends at each position. Dynamic programming keeps the best score and, with it, the number of tokens of
the path; there are no backpointers and no ids. Ties are the tokenizer's: of equal scores, the path
whose last piece starts first. Unknown characters count as their UTF-8 bytes where the model falls back
to bytes, and otherwise as one token a run.

The distinct chunks of a run of texts are counted once each. The model is read as unigram whatever its type
(see _pieces.as_unigram): from a BPE file, counts are those of the unigram search over its pieces and
scores, not those of the file's own merges.

Defined results: null and empty texts have no token; repeated rows are counted one by one; other
columns pass through.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import Store, free_name, map_batches
from ._pieces import Pieces, default_path, pieces

#: Bytes of chunks and counts kept a process.
KEPT_BYTES = 64 << 20
#: Texts are counted in runs of about this many bytes; one longer text makes a run of its own.
RUN_BYTES = 4 << 20


class Counter:
    def __init__(self, model: Pieces):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for text, score in model.scores.items():
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.kept = Store(KEPT_BYTES)

    def _count(self, text: str) -> int:
        n = len(text)
        score, count, unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            ending[end].append(found)
        fallback, penalty = self.model.byte_ids is not None, self.model.unk_score
        for end in range(1, n + 1):
            best, at, single = None, 0, False
            for size, own in sorted(ending[end - 1], reverse=True):  # longest first: it starts first
                total = score[end - size] + own
                single = size == 1
                if best is None or total > best:
                    best, at = total, end - size
            lost = False
            if not single:
                total = score[end - 1] + penalty
                if best is None or total > best:
                    best, at, lost = total, end - 1, True
            score[end], unknown[end] = best, lost
            if not lost:
                count[end] = count[at] + 1
            elif fallback:
                count[end] = count[at] + len(text[at:end].encode("utf-8", "replace"))
            else:
                count[end] = count[at] + (not unknown[at])
        return count[n]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; a null has none."""
        out, texts, size = [np.zeros(0, np.int64)], [], 0
        for t in column.to_pylist():
            texts.append(t or "")
            size += len(texts[-1])
            if size >= RUN_BYTES:
                out.append(self._run(texts))
                texts, size = [], 0
        return np.concatenate([*out, self._run(texts)])

    def _run(self, texts: list[str]) -> np.ndarray:
        chunks: list[str] = []
        ends = [0]
        for t in texts:
            chunks += self.model.chunks(t)
            ends.append(len(chunks))
        coded = pa.array(chunks, pa.large_string()).dictionary_encode()
        each = self.kept.look(coded.dictionary.to_pylist(), lambda new: {c: self._count(c) for c in new}, lambda _: 8)
        total = np.concatenate([[0], np.cumsum(np.array(each, np.int64)[coded.indices.to_numpy()])])
        return np.diff(total[ends])

    def count(self, text: str) -> int:
        return int(self._run([text])[0])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a process and file."""
    return Counter(pieces(path))


def count_tokens(docs: DataFrame, path: str | None = None, output: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``output`` (long)."""
    path = path or default_path()
    taken = docs.columns
    name, at = free_name(taken, output), taken.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(path)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.counts(batch.column(at)))], [*taken, name])

    return map_batches(docs, run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_tokens")
