"""Quality rules: votes, expectation maximisation over them, and a posterior that decides.

Each rule votes bad (-1), good (+1) or abstains (0) on a document. The votes of one document are one
of at most 3^len(RULES) patterns, so the corpus reduces to a histogram of patterns, counted over all
documents. Expectation maximisation on it estimates the share of good text and of each kind of junk and,
a rule and class, how often a vote that the rule casts is bad: its accuracy in that class. Whether a rule
abstains tells nothing. A document's posterior follows from its pattern alone, so that one bad vote does
not decide where the other rules, as accurate as they turned out to be, speak for the document.

The fit is one scan that shuffles only pattern counts; the decision is a second scan without any
shuffle. No text is moved or kept.

Defined results: a null or empty text has no words and fails the base; repeated rows are each judged
and counted; on an empty table the model is its prior; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, map_batches, text_bytes

#: Characters that count as symbols. Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_shouts", "n_marks", "n_varied", "n_windowed")
#: Words of a window in which different words are counted, so that variety does not fall with a text's length.
VARIETY = 100


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, np.int64)
    m[list(chars)] = 1
    return m


_WHITE, _SYMBOL = _mask(b" \t\n\x0b\x0c\r"), _mask(SYMBOLS)
_CONT, _LEAD = _mask(bytes(range(0x80, 0xC0))), _mask(bytes(range(0xC0, 0x100)))
_UPPER, _LOWER, _SHOUT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"!")
#: ASCII punctuation that prose has little of.
_MARKS = _mask(b"#$%&*+/<=>@[\\]^_`{|}~")


def repeated_words(ids: np.ndarray, n_distinct: int, window: int = WINDOW) -> int:
    """Words in ``window``-word windows that are found twice or more, the first included. Exact for any vocabulary."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key, size = ids.astype(np.int64), max(n_distinct, 2)
    base = key
    for k in range(1, window):
        if size * n_distinct >= 1 << 62:  # rename what there is so far, which exists at most len(ids) times
            found, key = np.unique(key, return_inverse=True)
            size = len(found)
        key = key[: len(ids) - k] * n_distinct + base[k:]
        size *= max(n_distinct, 2)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == key)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def varied_words(ids: np.ndarray, window: int = VARIETY) -> tuple[int, int]:
    """(different words, words), summed over windows that cover the whole text: one after another, and the last ``window`` words."""
    if len(ids) <= window:
        return len(np.unique(ids)), len(ids)
    whole = ids[: len(ids) // window * window].reshape(-1, window)
    x = np.sort(np.concatenate([whole, ids[None, -window:]]) if len(ids) % window else whole, axis=1)
    return int((x[:, 1:] != x[:, :-1]).sum()) + len(x), x.size


def signals(data: bytes | None) -> list[int]:
    """The values of SIGNALS and EXTRA for one whole text."""
    data = data or b""
    words = data.split()
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    codes = {w: k for k, w in enumerate(set(words))}
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    cont = int(seen @ _CONT)
    return [
        len(words), len(data) - cont - int(seen @ _WHITE), int(seen @ _SYMBOL), len(lines) - len(set(lines)), repeated_words(ids, len(codes)),
        len(lines), int(seen @ _UPPER), int(seen @ (_UPPER + _LOWER + _LEAD)), int(seen @ _SHOUT), int(seen @ _MARKS), *varied_words(ids),
    ]


def _between(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0))


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of all rules, a row a document, a column a rule in the order of RULES."""
    n, chars, lines, letters = (np.maximum(s[c], 1) for c in ("n_words", "word_chars", "n_lines", "n_letters"))
    symbols, marks, solid = s["n_symbols"] / n, s["n_marks"] / chars, s["n_letters"] / chars
    shouts, upper = s["n_shouts"] / n, s["n_upper"] / letters
    repeats, twice, varied = s["n_repeat_words"] / n, s["n_dup_lines"] / lines, s["n_varied"] / np.maximum(s["n_windowed"], 1)
    length, long_text = s["word_chars"] / n, s["n_words"] >= 20
    return np.stack([
        _between(symbols, symbols <= 0.02, symbols > 0.1),
        _between(marks, marks <= 0.005, marks > 0.03),
        _between(solid, solid >= 0.9, solid < 0.75),
        _between(shouts, shouts <= 0.02, shouts > 0.2),
        _between(upper, upper <= 0.1, (upper > 0.4) & (s["n_words"] >= 10)),
        _between(repeats, repeats <= 0.1, repeats > MAX_REPEAT_PERCENT / 100),
        _between(twice, twice <= 0.1, (twice > 0.3) & (s["n_lines"] >= 4)),
        _between(varied, (varied >= 0.7) & long_text, (varied < 0.5) & long_text),
        _between(length, (length >= 3) & (length <= 12), (length < 2) | (length > 20)),
    ], axis=1)


RULES = ("few_symbols", "few_marks", "mostly_letters", "no_shouting", "few_capitals", "no_repeats", "no_repeated_lines", "varied_words", "usual_word_length")
#: The kinds of junk and the rules that are there for each; a rule may be there for none.
KINDS = {"symbols": (0, 1, 2), "shouting": (3, 4), "repetition": (5, 6, 7)}
#: What is thought before any document is seen: how often a cast vote is bad on good text, on the rule's own kind of junk, and on other junk.
BEFORE = (0.02, 0.8, 0.1)
#: Documents that this counts as much as, a rule and class; and one document a class. The corpus soon outweighs it.
PRIOR_WEIGHT = 4.0


@dataclass(frozen=True)
class VoteModel:
    """Class 0 is good, class k + 1 the k-th of KINDS.

    prior[c]: share of a class; bad[c, r]: how often a vote that rule r casts on documents of class c is bad.
    """

    prior: np.ndarray
    bad: np.ndarray
    rounds: int

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior of every class, a row a row of votes."""
        like = np.log(self.prior) + (patterns < 0) @ np.log(self.bad).T + (patterns > 0) @ np.log1p(-self.bad).T
        like = np.exp(like - like.max(1, keepdims=True))
        return like / like.sum(1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        return self.classes(patterns)[:, 0]

    def accuracies(self) -> np.ndarray:
        """[r]: how often rule r is right, on average over good text and junk as far as it casts votes: the mean of a good vote's share on good text and a bad vote's on its kind of junk."""
        own = np.array([next((self.bad[k + 1, r] for k, rules in enumerate(KINDS.values()) if r in rules), np.nan) for r in range(len(RULES))])
        return np.where(np.isnan(own), 1 - self.bad[0], (1 - self.bad[0] + own) / 2)


def prior_rates() -> np.ndarray:
    """The rates of BEFORE, a row a class."""
    mean = np.full((len(KINDS) + 1, len(RULES)), BEFORE[2])
    mean[0] = BEFORE[0]
    for k, rules in enumerate(KINDS.values()):
        mean[k + 1, list(rules)] = BEFORE[1]
    return mean


def fit_votes(patterns: np.ndarray, counts: np.ndarray, max_rounds: int = 1000, tol: float = 1e-9) -> VoteModel:
    """Expectation maximisation on counted patterns.

    Junk comes in kinds that trip different rules, so one junk class would call the votes of the other
    rules evidence for good; hence a class a kind, whose rates are all estimated. They start from the rules'
    own word (the share of bad ones among a kind's votes) and from a prior that weighs PRIOR_WEIGHT documents.
    """
    patterns, counts = patterns.reshape(-1, len(RULES)), counts.astype(float)
    bad, cast, mean = (patterns < 0).astype(float), (patterns != 0).astype(float), prior_rates()
    kinds = [list(rules) for rules in KINDS.values()]
    part = np.stack([bad[:, r].sum(1) / np.maximum(cast[:, r].sum(1), 1) for r in kinds], axis=1)
    part = np.hstack([np.maximum(1 - part.sum(1, keepdims=True), 0.05), part])
    part /= part.sum(1, keepdims=True)
    model = VoteModel(np.full(len(mean), 1 / len(mean)), mean, 0)
    for k in range(max_rounds if len(counts) else 0):
        weight = part * counts[:, None]
        prior = weight.sum(0) + 1
        model = VoteModel(prior / prior.sum(), (weight.T @ bad + PRIOR_WEIGHT * mean) / (weight.T @ cast + PRIOR_WEIGHT), k + 1)
        last, part = part, model.classes(patterns)
        if np.abs(part - last).max() <= tol:
            break
    return model


def _code(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(len(RULES))).sum(1)


def _decode(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1


def _table(column: pa.Array) -> dict[str, np.ndarray]:
    rows = np.array([signals(x) for x in text_bytes(column)], np.int64).reshape(-1, len(SIGNALS) + len(EXTRA))
    return {name: rows[:, k] for k, name in enumerate(SIGNALS + EXTRA)}


def fit_quality(docs: DataFrame) -> VoteModel:
    """The model of all of ``docs``. At most 3^len(RULES) pattern counts reach the driver, however many documents there are."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, n = np.unique(_code(votes(_table(batch.column(0)))), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    rows = map_batches(docs.select("text"), count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return fit_votes(_decode(np.array([r["code"] for r in rows], np.int64)), np.array([r["n"] for r in rows], np.int64))


def judge(docs: DataFrame, model: VoteModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with the base signals, base_failed, the posterior and kept.

    Columns of these names that ``docs`` has already keep theirs; the new ones then get a leading "_".
    """
    model = model or fit_quality(docs)
    taken = docs.columns
    at = taken.index("text")
    names = [free_name(taken, c) for c in (*SIGNALS, "base_failed", "posterior", "kept")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ", ".join(f"`{c}` {t}" for c, t in zip(names, ["long"] * 5 + ["boolean", "double", "boolean"]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _table(batch.column(at))
        failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
        good = model.posterior(votes(s))
        new = [*(pa.array(s[c]) for c in SIGNALS), pa.array(failed), pa.array(good), pa.array(~failed & (good >= threshold))]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*taken, *names])

    return map_batches(docs, run, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.drop("text", "posterior")
