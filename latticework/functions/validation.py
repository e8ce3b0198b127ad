"""Checks of options and of frames, raising ValueError with the condition that failed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
OPTIMIZERS = ("sgd", "momentum", "adam", "adagrad", "rmsprop")


def _fail(what: str, got: Any) -> None:
    raise ValueError(f"expected {what}, got: {got!r}")


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def positive_number(x: Any) -> float:
    return x if _number(x) and x > 0 else _fail("a positive number", x)


def non_negative_number(x: Any) -> float:
    return x if _number(x) and x >= 0 else _fail("a non-negative number", x)


def non_negative_integer(x: Any) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else _fail("a non-negative integer", x)


def positive_integer(x: Any) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) and x > 0 else _fail("a positive integer", x)


def beta(x: Any) -> float:
    return non_negative_number(x)


def quantile_range(x: Any) -> tuple[float, float]:
    low, high = x if isinstance(x, tuple) and len(x) == 2 else (None, None)
    return x if _number(low) and _number(high) and 0 < low < high < 100 else _fail("a range (low, high) with 0 < low < high < 100", x)


def axis(x: Any) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) else _fail("an axis", x)


def axes(x: Any) -> list[int] | None:
    return x if x is None or isinstance(x, (list, tuple)) and all(isinstance(k, int) for k in x) else _fail("a list of axes or None", x)


def column_type(x: Any) -> str:
    return x if x in NUMERIC else _fail(f"one of the types {NUMERIC}", x)


def seed(x: Any) -> int:
    return x if isinstance(x, int) and not isinstance(x, bool) else _fail("an integer seed", x)


def weights(x: Any) -> Any:
    """A weight column by name, a list of numbers, or None."""
    return x if x is None or isinstance(x, (str, Column)) or isinstance(x, (list, tuple)) and all(_number(k) for k in x) else _fail("a weight column or a flat list of numbers", x)


def multi_weights(x: Any) -> Any:
    return x if x is None or isinstance(x, (list, tuple)) and all(isinstance(r, (list, tuple)) for r in x) else _fail("rows of weights", x)


def optimizer(x: Any) -> Any:
    """A name of OPTIMIZERS, or a pair of functions (init, update)."""
    ok = x in OPTIMIZERS if isinstance(x, str) else isinstance(x, tuple) and len(x) == 2 and all(map(callable, x))
    return x if ok else _fail(f"an optimizer of {OPTIMIZERS} or a pair (init, update)", x)


def one_of(x: Any, options: Iterable[Any]) -> Any:
    options = list(options)
    return x if x in options else _fail(f"one of {options}", x)


def loss_function(f: Any) -> Callable:
    return f if callable(f) else _fail("a loss function of (scores, targets)", f)


def assert_rank(df: DataFrame, column: str, rank: int) -> None:
    """Rank 1 is a numeric column, rank 2 an array of numbers, and so on."""
    kind = dict(df.dtypes)[column]
    if kind.count("array<") != rank - 1:
        _fail(f"column {column} of rank {rank}", kind)


def target(df: DataFrame, column: str) -> str:
    """A column of one number a row."""
    kind = dict(df.dtypes).get(column)
    return column if kind in NUMERIC or kind == "boolean" or str(kind).startswith("decimal") else _fail(f"a numeric target column {column}", kind)


def assert_same_columns(left: DataFrame, right: DataFrame, columns: list[str]) -> None:
    a, b = dict(left.dtypes), dict(right.dtypes)
    bad = [c for c in columns if a.get(c) != b.get(c)]
    if bad:
        _fail(f"equal types of {bad}", [(a.get(c), b.get(c)) for c in bad])


def assert_same_size(x: str, y: str) -> Column:
    """True, or an error in the job when the arrays of a row differ in size."""
    return F.assert_true(F.size(x) == F.size(y), F.lit(f"{x} and {y} differ in size")).isNull()


def to_float(c: str) -> Column:
    return F.col(c).cast("double")


def weight_column(w: str | float | None) -> Column:
    return F.lit(1.0) if w is None else F.col(w).cast("double") if isinstance(w, str) else F.lit(float(w))


def valid_broadcast(n: int, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
    """The common shape of two shapes of ``n`` axes."""
    if len(left) != n or len(right) != n or any(a != b and 1 not in (a, b) for a, b in zip(left, right)):
        _fail(f"shapes of {n} axes that can be broadcast", (left, right))
    return tuple(max(a, b) for a, b in zip(left, right))
