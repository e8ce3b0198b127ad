"""A filter that is not full but takes no more keys."""

import numpy as np

from latticework.llm import line_dedup


def test_failed_insertion_keeps_the_shards_other_keys(spark):
    # Keys whose two buckets of two are the same: the fifth of one bucket fits nowhere, in any order.
    lines = {0: [], 1: []}
    for k in range(1000):
        line = f"a line that is long enough to be counted, number {k}"
        h = np.frombuffer(line_dedup._keys_of(line.encode(), line_dedup.MIN_CHARS)[0][1], "<i8").copy()
        _, i, j = line_dedup.CuckooFilter(2)._places(h[:1], h[1:])
        if i[0] == j[0]:
            lines[int(i[0])].append(line)
    old, new = [*lines[0][:4], *lines[1][:2]], lines[0][4]
    frame = lambda ids, text: spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    first, second = frame([1, 2], "\n".join(old)), frame([3, 4], new)
    drops = lambda i: sorted(map(tuple, i.drops().collect()))
    index = line_dedup.LineIndex.create(spark, first, min_docs=2).insert(second)
    want = drops(line_dedup.LineIndex.create(spark, first.unionAll(second), min_docs=2))
    assert len({r[:2] for r in want}) == 7
    assert drops(index) == want
