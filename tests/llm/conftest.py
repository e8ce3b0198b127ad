import random

import pytest

WORDS = [f"word{k}" for k in range(400)]


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_texts():
    """Texts with nulls, blanks, repeats, shared passages, runs of one word and a very long one."""
    shared = prose(77, 40)
    out = [None, "", "   \n\t ", "one", "two words", prose(1), prose(1), prose(1) + " tail", shared + " " + prose(2), prose(3) + " " + shared, "a " * 60, "x " + "a " * 70 + "y", prose(4, 9000), "ÉTÉ naïve 日本語 \x85 \x1c b"]
    line = "The same line, which is long enough to count as one, stands here."
    out += [f"{prose(k, 15)}\n  {line.upper() if k % 2 else line} \n{prose(k, 12)}" for k in range(20, 27)]
    return out + [" ".join(prose(9, 90).split()[k:]) for k in range(4)]


@pytest.fixture(scope="session")
def edges(spark):
    """(doc_id, text, and extra columns whose names clash with the operators' own)."""
    rows = [(k * 3 + 5, t, k, "s", True) for k, t in enumerate(edge_texts())]
    rows += [rows[5], rows[8]]  # repeated rows
    rows += [(None, "a row without an id, of words that nothing else has", 1, None, None)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, lw_doc string, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
