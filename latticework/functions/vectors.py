"""Column builders over ARRAY<DOUBLE>: distances, similarities and small vector algebra, all inside codegen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
Metric = Callable[[ColumnLike, ColumnLike], Column]


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c: ColumnLike) -> Column:
    """An array of any numbers as ARRAY<DOUBLE>."""
    return col(c).cast("array<double>")


def pack(cols: list[str]) -> Column:
    """Wide columns as one array."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(x: ColumnLike, y: ColumnLike) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def dot_literal(x: ColumnLike, weights: list[float]) -> Column:
    """Inner product with constants; a balanced tree of products keeps the expression shallow."""
    if not weights:
        return F.lit(0.0)
    terms = [F.element_at(col(x), k + 1) * F.lit(float(w)) for k, w in enumerate(weights)]
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[k : k + 2]) for k in range(0, len(terms), 2)]
    return terms[0]


def norm(x: ColumnLike) -> Column:
    return F.sqrt(dot(x, x))


def squared_euclidean(x: ColumnLike, y: ColumnLike) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: (a - b) * (a - b)))


def euclidean(x: ColumnLike, y: ColumnLike) -> Column:
    return F.sqrt(squared_euclidean(x, y))


def manhattan(x: ColumnLike, y: ColumnLike) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: F.abs(a - b)))


def chebyshev(x: ColumnLike, y: ColumnLike) -> Column:
    return F.coalesce(F.array_max(F.zip_with(col(x), col(y), lambda a, b: F.abs(a - b))), F.lit(0.0))


def minkowski(x: ColumnLike, y: ColumnLike, p: float | str = 2.0) -> Column:
    """The L_p distance; p of 1, 2 and infinity have their own forms."""
    if p in ("infinity", float("inf")):
        return chebyshev(x, y)
    if not p > 0:
        raise ValueError(f"p must be positive, got {p!r}")
    if p == 1:
        return manhattan(x, y)
    if p == 2:
        return euclidean(x, y)
    return F.pow(total(F.zip_with(col(x), col(y), lambda a, b: F.pow(F.abs(a - b), F.lit(float(p))))), F.lit(1.0 / p))


def cosine(x: ColumnLike, y: ColumnLike) -> Column:
    """Cosine distance, never below 0. Two zero vectors are 0 apart, a zero and another one 1."""
    nx, ny = norm(x), norm(y)
    some = F.greatest(F.lit(0.0), 1 - dot(x, y) / (nx * ny))
    return F.when((nx == 0) & (ny == 0), 0.0).when((nx == 0) | (ny == 0), 1.0).otherwise(some)


def pairwise_cosine_distance(x: ColumnLike, y: ColumnLike) -> Column:
    """As ``cosine``, but a zero vector is 1 from everything."""
    nx, ny = norm(x), norm(y)
    return F.when((nx == 0) | (ny == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(x, y) / (nx * ny)))


def hamming(x: ColumnLike, y: ColumnLike, weights: ColumnLike | None = None) -> Column:
    """Share of unequal components; with weights, their share of the weight."""
    unequal = F.zip_with(col(x), col(y), lambda a, b: (a != b).cast("double"))
    if weights is None:
        return total(unequal) / F.size(col(x))
    w = col(weights)
    return total(F.zip_with(unequal, w, lambda u, v: u * v)) / total(w)


def jaccard(x: ColumnLike, y: ColumnLike) -> Column:
    """Of the sets of values."""
    union = F.size(F.array_union(col(x), col(y)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(col(x), col(y))) / union)


def binary_jaccard(x: ColumnLike, y: ColumnLike) -> Column:
    both = total(F.zip_with(col(x), col(y), lambda a, b: ((a != 0) & (b != 0)).cast("double")))
    some = total(F.zip_with(col(x), col(y), lambda a, b: ((a != 0) | (b != 0)).cast("double")))
    return F.when(some == 0, 0.0).otherwise(both / some)


def dice_coefficient(x: ColumnLike, y: ColumnLike) -> Column:
    j = jaccard(x, y)
    return 2 * j / (1 + j)


def dice_coefficient_binary(x: ColumnLike, y: ColumnLike) -> Column:
    j = binary_jaccard(x, y)
    return 2 * j / (1 + j)


def normalized(x: ColumnLike, kind: str = "euclidean") -> Column:
    """A row divided by its norm; a zero row stays."""
    x = col(x)
    size = {
        "euclidean": norm(x),
        "manhattan": total(F.transform(x, F.abs)),
        "chebyshev": F.array_max(F.transform(x, F.abs)),
    }[kind]
    return F.transform(x, lambda v: v / F.when(size == 0, 1.0).otherwise(size))


_NAMED: dict[str, Metric] = {
    "euclidean": euclidean,
    "squared_euclidean": squared_euclidean,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
    "cosine": cosine,
}


def metric(m: str | tuple[str, float] | Metric) -> Metric:
    """A metric between two rows by name, as ("minkowski", p), or as a function that builds a Column."""
    if callable(m):
        return m
    if isinstance(m, tuple) and len(m) == 2 and m[0] == "minkowski":
        return lambda x, y: minkowski(x, y, m[1])
    if isinstance(m, str) and m in _NAMED:
        return _NAMED[m]
    raise ValueError(f"unknown metric {m!r}: one of {sorted(_NAMED)}, ('minkowski', p) or a function")


def pairwise_metric(m: str | tuple[str, float] | Metric) -> Metric:
    """As ``metric``, with the pairwise treatment of zero vectors."""
    return pairwise_cosine_distance if m == "cosine" else metric(m)


def argmin_index(a: ColumnLike) -> Column:
    """Index from 0 of the smallest component, the first of equal ones."""
    return F.array_position(col(a), F.array_min(col(a))).cast("int") - 1


def argmax_index(a: ColumnLike) -> Column:
    return F.array_position(col(a), F.array_max(col(a))).cast("int") - 1


def logsumexp(a: ColumnLike) -> Column:
    top = F.array_max(col(a))
    return top + F.log(total(F.transform(col(a), lambda v: F.exp(v - top))))


def softmax(a: ColumnLike) -> Column:
    shift = logsumexp(a)
    return F.transform(col(a), lambda v: F.exp(v - shift))
