"""Substring dedup by recompression: long repeats are found by shared high-level symbols.

The words of every text are named by a hash of their bytes, so a name is global without a table. Then
come rounds of renaming. First every run of one word becomes a symbol; then, a round, each symbol is
drawn left or right by a bit of its own name, and each neighbouring pair (left, right) becomes the
symbol named by the two. What happens to a symbol depends on it and its neighbours alone, and each
symbol carries the *reach* of words that it depends on: wherever these words stand, the same symbol
arises. Equal substrings so have equal symbols inside.

A window of ``window`` words is anchored at the longest symbol whose reach lies inside it (ties: the
largest name), or at its own name if there is none (within runs). Equal windows have equal anchors, and
a few neighbouring windows share one. One road at every size:

1. Anchors are dealt out by name, and those that two documents have go back to their documents. An anchor
   that documents of one batch share is known to be shared there: its rows go straight on, and one row
   stands for them, so that no anchor has more rows in a task than there are batches.
2. A document's shared anchors are joined to it, and it gives out the windows at these; the exact check
   follows. A batch keeps the smallest document of a window only, since in the others it is a repeat; the
   windows kept are dealt out by name, and in any but the smallest document they are repeats. Windows are
   compared by 64 bits of name and 32 of anchor together.
3. Words that a repeat covers are cut out of the text.

Defined results: null, empty and short texts have no window; rows with a null doc_id lose nothing and
cause no loss; rows that share a doc_id never count as each other's repeats, and word positions found
in one of them are cut from each; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, free_name, map_batches, partitions_of, text_bytes
from ._words import mix, windows, word_runs

WINDOW, ROUNDS = 13, 5
#: Anchors or windows of a batch: what is known within one is combined before the shuffle.
BATCH = 1 << 20
_SPAN_SHIFT = np.uint64(58)


def anchors(names: np.ndarray, split: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, anchor) of every window of the texts whose words are names[split[k]:split[k + 1]]."""
    sizes = np.diff(split)
    n_texts = len(sizes)
    # One stop before, between and after the texts: no symbol goes over it, no reach that holds it is in a window.
    total = len(names) + n_texts + 1
    word_at = np.arange(len(names)) + np.repeat(np.arange(1, n_texts + 1), sizes)
    symbol, stop = np.zeros(total, np.uint64), np.ones(total, bool)
    symbol[word_at], stop[word_at] = names, False
    best = np.zeros(total, np.uint64)

    def offer(name: np.ndarray, low: np.ndarray, high: np.ndarray, span: np.ndarray) -> None:
        rank = (np.minimum(span, 63).astype(np.uint64) << _SPAN_SHIFT) | (name >> np.uint64(6))
        spare = window - 1 - (high - low)
        for t in range(window):
            fits = spare >= t
            if not fits.any():
                break
            rank, low, spare = rank[fits], low[fits], spare[fits]
            at = low - t
            ok = at >= 0
            np.maximum.at(best, at[ok], rank[ok])

    # Token runs.
    head = np.ones(total, bool)
    head[1:] = (symbol[1:] != symbol[:-1]) | stop[1:] | stop[:-1]
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, total))
    stop = stop[start]
    symbol = mix(symbol[start] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low, high = np.maximum(start - 1, 0), np.minimum(start + length, total - 1)
    span = length
    offer(symbol[~stop], low[~stop], high[~stop], span[~stop])
    # Pairs.
    draw = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(rounds):
        side = (mix(symbol + draw[k]) & np.uint64(1)).astype(bool)
        left, right = ~side & ~stop, side & ~stop
        first = np.zeros(len(symbol), bool)
        first[:-1] = left[:-1] & right[1:]
        second = np.zeros(len(symbol), bool)
        second[1:] = first[:-1]
        at = np.flatnonzero(first)
        merged = mix(symbol[at] * np.uint64(0x100000001B3) + mix(symbol[at + 1] + np.uint64(k)))
        new_low, new_high = low.copy(), high.copy()
        # A symbol that stays single does so because of the neighbour that it could have been paired with.
        new_high[:-1] = np.where(left[:-1] & ~first[:-1], np.maximum(high[:-1], high[1:]), high[:-1])
        new_low[1:] = np.where(right[1:] & ~second[1:], np.minimum(low[1:], low[:-1]), low[1:])
        new_low[at], new_high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        span = span.copy()
        span[at] += span[at + 1]
        symbol = symbol.copy()
        symbol[at] = merged
        offer(merged, new_low[at], new_high[at], span[at])
        keep = ~second
        symbol, stop, span, low, high = symbol[keep], stop[keep], span[keep], new_low[keep], new_high[keep]
    # Windows that lie within one text.
    n_windows = np.maximum(sizes - window + 1, 0)
    text = np.repeat(np.arange(n_texts), n_windows)
    first = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    anchor = best[split[:-1][text] + first + text + 1]
    bare = anchor == 0
    if bare.any():
        anchor[bare] = window_names(names, split, text[bare], first[bare], window) >> np.uint64(6)
    return first, text, anchor


def window_names(names: np.ndarray, split: np.ndarray, text: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    return windows(names, window)[split[:-1][text] + first]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; at least one row is needed."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


#: kind: DONE needs no partner any more; ONE may find one in its task; SEVERAL (of anchors) stands for rows that are DONE.
DONE, ONE, SEVERAL = 0, 1, 2
ANCHOR_ROWS = "anchor long, doc long, kind int"


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def combined(anchor: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        once = _heads(anchor, doc)
        anchor, doc = anchor[once], doc[once]
        head = _heads(anchor)
        size = np.diff(np.append(head, len(anchor)))
        more = head[size > 1]
        kind = np.repeat(np.where(size > 1, DONE, ONE), size)
        columns = (np.concatenate([anchor, anchor[more]]), np.concatenate([doc, doc[more]]), np.concatenate([kind, np.full(len(more), SEVERAL)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "doc", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for begin, _, names, split, _, _ in word_runs(batch.column(1)):
                _, text, anchor = anchors(names, split, window)
                if len(text):
                    at = _heads(anchor, text)
                    parts.append((anchor[at].view(np.int64), ids[begin + text[at]]))
                if sum(len(p[0]) for p in parts) >= BATCH:
                    yield combined(*map(np.concatenate, zip(*parts)))
                    parts = []
        if parts:
            yield combined(*map(np.concatenate, zip(*parts)))

    return docs.select("doc_id", "text").mapInArrow(run, ANCHOR_ROWS)


def _shared(rows: DataFrame) -> DataFrame:
    """(doc, anchor) of the anchors that two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the anchor at the end of the batch before: name, a document, whether it is shared
        for batch in batches:
            anchor, doc, kind = (batch.column(k).to_numpy() for k in range(3))
            out = [(doc[kind == DONE], anchor[kind == DONE])]
            at = np.flatnonzero(kind != DONE)
            if len(at):
                a, d, k = anchor[at], doc[at], kind[at]
                head = _heads(a)
                size = np.diff(np.append(head, len(a)))
                shared = (np.maximum.reduceat(k, head) == SEVERAL) | (np.maximum.reduceat(d, head) != np.minimum.reduceat(d, head))
                if last is not None and last[0] == a[0]:
                    if last[2]:
                        shared[0] = True
                    elif shared[0] or d[0] != last[1]:
                        shared[0] = True
                        out.append((np.array([last[1]]), np.array([last[0]])))
                keep = np.repeat(shared, size) & (k == ONE)
                out.append((d[keep], a[keep]))
                last = (a[-1], d[-1], shared[-1])
            doc, anchor = map(np.concatenate, zip(*out))
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor)], ["doc", "anchor"])

    dealt = rows.repartition(partitions_of(rows.sparkSession), F.when(F.col("kind") == DONE, F.xxhash64("doc")).otherwise(F.col("anchor")))
    return dealt.sortWithinPartitions("anchor", "doc").mapInArrow(run, "doc long, anchor long")


WINDOW_ROWS = "name long, anchor int, doc long, block int, mask long, kind int"


def _keyed(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return anchor.view(np.uint64) ^ mix(text.astype(np.uint64) + np.uint64(1))


def _window_rows(docs: DataFrame, window: int) -> DataFrame:
    """WINDOW_ROWS of documents (doc_id, text, anchors), at these anchors. Window first of a document is bit first % 64 of its block first / 64."""

    def combined(name: np.ndarray, anchor: np.ndarray, doc: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        block, bit = (first >> 6).astype(np.int32), np.uint64(1) << (first & 63).astype(np.uint64)
        order = np.lexsort((block, doc, anchor, name))
        name, anchor, doc, block, bit = (x[order] for x in (name, anchor, doc, block, bit))
        head = _heads(name, anchor)
        late = doc > np.repeat(doc[head], np.diff(np.append(head, len(doc))))
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for kind, own in ((ONE, np.flatnonzero(~late)), (DONE, np.flatnonzero(late))):
            if not len(own):
                continue
            n, a, d, b, m = (x[own] for x in (name, anchor, doc, block, bit))
            if kind == DONE:  # only the document's own places matter from here
                order = np.lexsort((b, d))
                d, b, m = d[order], b[order], m[order]
                n, a = d, np.zeros(len(d), np.int32)
            at = _heads(n, a, d, b)
            for column, values in zip(columns, (n[at], a[at], d[at], b[at], np.bitwise_or.reduceat(m, at).view(np.int64), np.full(len(at), kind, np.int32))):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["name", "anchor", "doc", "block", "mask", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            ends, listed = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            for begin, end, names, split, _, _ in word_runs(batch.column(1)):
                first, text, anchor = anchors(names, split, window)
                # Text and anchor in one number; what is let through by chance has no partner later.
                own = listed[ends[begin] - ends[0] : ends[end] - ends[0]]
                keys = np.sort(_keyed(np.repeat(np.arange(end - begin), np.diff(ends[begin : end + 1])), own))
                asked = _keyed(text, anchor)
                keep = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked) if len(keys) else []
                if len(keep):
                    first, text, anchor = first[keep], text[keep], anchor[keep]
                    name = window_names(names, split, text, first, window)
                    parts.append((name.view(np.int64), (anchor >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[begin + text], first))
                if sum(len(p[0]) for p in parts) >= BATCH:
                    yield combined(*map(np.concatenate, zip(*parts)))
                    parts = []
        if parts:
            yield combined(*map(np.concatenate, zip(*parts)))

    return docs.select("doc_id", "text", "anchors").mapInArrow(run, WINDOW_ROWS)


def _repeats(rows: DataFrame) -> DataFrame:
    """(doc, block, mask) of the windows that a smaller document has too: equal ones stream by in the order of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the window at the end of the batch before: name, anchor, smallest document
        for batch in batches:
            name, anchor, doc, kind = (batch.column(k).to_numpy() for k in (0, 1, 2, 5))
            gone = kind == DONE
            at = np.flatnonzero(~gone)
            if len(at):
                n, a, d = name[at], anchor[at], doc[at]
                head = _heads(n, a)
                least = d[head].copy()
                if last is not None and (n[0], a[0]) == last[:2]:
                    least[0] = last[2]
                last = (n[-1], a[-1], least[-1])
                gone[at] = d > np.repeat(least, np.diff(np.append(head, len(d))))
            if gone.any():
                yield batch.select(["doc", "block", "mask"]).filter(pa.array(gone))

    dealt = rows.repartition(partitions_of(rows.sparkSession), F.when(F.col("kind") == DONE, F.xxhash64("doc")).otherwise(F.col("name")))
    return dealt.sortWithinPartitions("name", "anchor", "doc").mapInArrow(run, "doc long, block int, mask long")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, cuts): for documents that have any, the windows that a smaller document has too, as pairs (block, 64 bits)."""
    scratch = Scratch(docs.sparkSession)
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A document's anchors: no more than it has words.
    lists = scratch.put(_shared(_anchor_rows(own, window)).groupBy("doc").agg(F.collect_list("anchor").alias("anchors")), "lists")
    scratch.release()
    found = scratch.put(_repeats(_window_rows(own.join(lists.hint("merge"), F.col("doc_id") == F.col("doc")), window)), "found")
    scratch.drop("lists")
    scratch.release()
    masks = found.groupBy("doc", "block").agg(F.bit_or("mask").alias("mask"))
    # A document's blocks: no more than its own words over 64.
    cuts = scratch.put(masks.groupBy("doc").agg(F.collect_list(F.struct("block", "mask")).alias("cuts")), "cuts")
    scratch.drop("found")
    scratch.release()
    return cuts


def _covered(cuts: list[dict] | None, n_words: int, window: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    for c in cuts or ():
        bits = np.unpackbits(np.array([c["mask"]], "<i8").view(np.uint8), bitorder="little")
        at = c["block"] * 64 + np.flatnonzero(bits)
        at = at[at < n_words]
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + window, n_words), -1)
    return np.cumsum(edge)[:-1] > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, joined_words: bool = False) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``, and n_words and n_removed (long).

    What is left keeps its white space; a cut takes the white space after its last word along. With
    ``joined_words``, text is the words left, joined by one space. Columns of the new names that
    ``docs`` has keep theirs; the new ones then get a leading "_".
    """
    taken = docs.columns
    n_words, n_removed, cuts, same = (free_name(taken, c) for c in ("n_words", "n_removed", "lw_cuts", "lw_doc"))
    found = repeats(docs, window).withColumnsRenamed({"doc": same, "cuts": cuts})
    # The cuts grow with the corpus: always a merge join.
    joined = docs.join(found.hint("merge"), docs["doc_id"].cast("long") == found[same], "left").drop(same)
    at = taken.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{n_words}` long, `{n_removed}` long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut_lists, column = batch.column(len(taken)).to_pylist(), batch.column(at)
        datas, texts, total, removed = text_bytes(column), [], [], []
        for begin, end, _, split, starts, ends in word_runs(column):
            for k in range(begin, end):
                a, b = split[k - begin], split[k - begin + 1]
                n, data = int(b - a), datas[k]
                total.append(n)
                gone = _covered(cut_lists[k], n, window) if cut_lists[k] else np.zeros(n, bool)
                removed.append(int(gone.sum()))
                if joined_words:
                    s, e = starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist()
                    data = b" ".join([data[x:y] for x, y in zip(s, e)]) if n else b""
                elif gone.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    left, parts = 0, []
                    for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        parts.append(data[left : starts[a + x]])
                        left = starts[a + y] if y < n else len(data)
                    data = b"".join([*parts, data[left:]])
                texts.append(data)
        columns = [batch.column(k) for k in range(len(taken))]
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*taken, n_words, n_removed])

    return map_batches(joined.select(*[docs[c] for c in taken], cuts), run, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), joined_words=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 12)) AS t(i)),
m AS (SELECT g, min(doc_id) AS low FROM k GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM k JOIN m USING (g), unnest(generate_series(0, 12)) AS t(o) WHERE doc_id > low),
x AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda p: NOT list_contains(ps, p)), lambda p: w[p]), ' ') END) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
