"""Scaling, encoding and vectorising. Models are plain parameters of a size fixed by the number of columns or categories.

Numbers of a column and of a category table are found in one aggregation; transforms are projections
(no join, no shuffle) for columns, and a broadcast only of a category table whose size is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validation as V
from ..functions import vectors
from .stats import quantiles


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def _stats(df: DataFrame, exprs: dict[str, Column]) -> dict[str, float]:
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first()
    return {k: row[k] for k in exprs}


@dataclass(frozen=True)
class ColumnScaler:
    """x -> (x - shift) / scale * factor + base, a column by itself."""

    shift: dict[str, float]
    scale: dict[str, float]
    factor: float = 1.0
    base: float = 0.0

    def column(self, c: str) -> Column:
        out = (_num(c) - F.lit(self.shift[c])) / F.lit(self.scale[c])
        if self.factor != 1.0:
            out = out * F.lit(self.factor)
        return out + F.lit(self.base) if self.base != 0.0 else out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.shift})


def _pooled(df: DataFrame, cols: list[str], per_column: bool, exprs: dict[str, object]) -> dict[str, dict[str, float]]:
    """Aggregates a column, or one for all values together."""
    if per_column:
        flat = _stats(df, {f"{c}|{k}": e(_num(c)) for c in cols for k, e in exprs.items()})
        return {c: {k: flat[f"{c}|{k}"] for k in exprs} for c in cols}
    whole = df.select(F.explode(F.array(*[_num(c) for c in cols])).alias("v"))
    one = _stats(whole, {k: e(F.col("v")) for k, e in exprs.items()})
    return {c: one for c in cols}


class StandardScaler:
    """Mean 0 and population deviation 1. What has no spread passes through unscaled, its mean taken as 0."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], per_column: bool = False) -> ColumnScaler:
        s = _pooled(df, cols, per_column, {"m": F.avg, "s": F.stddev_pop})
        return ColumnScaler({c: 0.0 if s[c]["s"] == 0 else s[c]["m"] for c in cols}, {c: s[c]["s"] or 1.0 for c in cols})

    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], per_column: bool = False) -> DataFrame:
        return StandardScaler.fit(df, cols, per_column).transform(df)


class MaxAbsScaler:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], per_column: bool = False) -> ColumnScaler:
        s = _pooled(df, cols, per_column, {"m": lambda c: F.max(F.abs(c))})
        return ColumnScaler(dict.fromkeys(cols, 0.0), {c: s[c]["m"] or 1.0 for c in cols})

    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], per_column: bool = False) -> DataFrame:
        return MaxAbsScaler.fit(df, cols, per_column).transform(df)


class MinMaxScaler:
    """To [low, high]; what has no spread goes to ``low``."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], per_column: bool = False, min_bound: float = 0.0, max_bound: float = 1.0) -> ColumnScaler:
        if not max_bound > min_bound:
            raise ValueError(f"max_bound must be over min_bound, got {max_bound} and {min_bound}")
        s = _pooled(df, cols, per_column, {"lo": F.min, "hi": F.max})
        return ColumnScaler({c: s[c]["lo"] for c in cols}, {c: (s[c]["hi"] - s[c]["lo"]) or 1.0 for c in cols}, float(max_bound - min_bound), float(min_bound))

    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], **opts) -> DataFrame:
        return MinMaxScaler.fit(df, cols, **opts).transform(df)


class RobustScaler:
    """By exact median and percentile range of each column."""

    @staticmethod
    def fit(df: DataFrame, cols: list[str], quantile_range: tuple[float, float] = (25.0, 75.0)) -> ColumnScaler:
        low, high = V.quantile_range(quantile_range)
        q = quantiles(df, {c: _num(c) for c in cols}, [low / 100, 0.5, high / 100])
        return ColumnScaler({c: q[c][1] for c in cols}, {c: (q[c][2] - q[c][0]) or 1.0 for c in cols})

    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], quantile_range: tuple[float, float] = (25.0, 75.0)) -> DataFrame:
        return RobustScaler.fit(df, cols, quantile_range).transform(df)


class Normalizer:
    """Rows (over ``cols`` side by side) or columns divided by their norm; a zero norm counts as 1."""

    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], norm: str = "euclidean", rows: bool = True) -> DataFrame:
        V.one_of(norm, ("euclidean", "chebyshev", "manhattan"))
        if rows:
            size = {
                "euclidean": F.sqrt(sum((_num(c) * _num(c) for c in cols), F.lit(0.0))),
                "manhattan": sum((F.abs(_num(c)) for c in cols), F.lit(0.0)),
                "chebyshev": F.greatest(*[F.abs(_num(c)) for c in cols]) if len(cols) > 1 else F.abs(_num(cols[0])),
            }[norm]
            return df.withColumns({c: _num(c) / F.when(size == 0, 1.0).otherwise(size) for c in cols})
        agg = {"euclidean": lambda c: F.sqrt(F.sum(c * c)), "manhattan": lambda c: F.sum(F.abs(c)), "chebyshev": lambda c: F.max(F.abs(c))}[norm]
        s = _stats(df, {c: agg(_num(c)) for c in cols})
        return ColumnScaler(dict.fromkeys(cols, 0.0), {c: s[c] or 1.0 for c in cols}).transform(df)


class Binarizer:
    @staticmethod
    def fit_transform(df: DataFrame, cols: list[str], threshold: float = 0.0, type: str = "int") -> DataFrame:
        return df.withColumns({c: (F.col(c) > F.lit(threshold)).cast(V.column_type(type)) for c in cols})


#: A category table of this many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_CATEGORIES = 200_000


@dataclass(frozen=True)
class OrdinalModel:
    """(category, code): the distinct values in order, numbered from 0."""

    column: str
    categories: DataFrame
    n: int

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        """Codes; -1 for values that weren't there at fitting."""
        table = F.broadcast(self.categories) if self.n <= BROADCAST_CATEGORIES else self.categories
        out = output or self.column
        joined = df.join(table, F.col(self.column).eqNullSafe(F.col("lw_category")), "left")
        return joined.withColumn(out, F.coalesce(F.col("lw_code"), F.lit(-1))).drop("lw_category", "lw_code")

    def inverse_transform(self, df: DataFrame, output: str) -> DataFrame:
        table = F.broadcast(self.categories) if self.n <= BROADCAST_CATEGORIES else self.categories
        return df.join(table, F.col(self.column) == F.col("lw_code"), "left").withColumn(output, F.col("lw_category")).drop("lw_category", "lw_code")


class OrdinalEncoder:
    @staticmethod
    def fit(df: DataFrame, column: str, num_categories: int | None = None) -> OrdinalModel:
        """The distinct values, the first ``num_categories`` of them in order.

        Distinct is a pre-aggregated shuffle; numbering goes over the distinct values alone, whose count
        is that of the model's rows.
        """
        found = df.select(F.col(column).alias("lw_category")).where(F.col("lw_category").isNotNull()).distinct().orderBy("lw_category")
        if num_categories is not None:
            found = found.limit(V.positive_integer(num_categories))
        values = [r[0] for r in found.collect()]
        kind = df.schema[column].dataType.simpleString()
        table = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], f"lw_category {kind}, lw_code int")
        return OrdinalModel(column, table, len(values))

    @staticmethod
    def fit_transform(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        return OrdinalEncoder.fit(df, column).transform(df, output)


class OneHotEncoder:
    @staticmethod
    def fit(df: DataFrame, column: str, num_categories: int | None = None) -> OrdinalModel:
        return OrdinalEncoder.fit(df, column, num_categories)

    @staticmethod
    def transform(model: OrdinalModel, df: DataFrame, output: str) -> DataFrame:
        """An array of 0 and 1; all 0 for values that weren't there at fitting."""
        code = model.transform(df, "lw_onehot")
        return code.withColumn(output, F.transform(F.sequence(F.lit(0), F.lit(model.n - 1)), lambda k: (k == F.col("lw_onehot")).cast("int"))).drop("lw_onehot")

    @staticmethod
    def fit_transform(df: DataFrame, column: str, output: str, num_categories: int | None = None) -> DataFrame:
        return OneHotEncoder.transform(OneHotEncoder.fit(df, column, num_categories), df, output)


class CountVectorizer:
    """Counts of token ids a document; negative ids are padding."""

    @staticmethod
    def max_token_id(df: DataFrame, tokens: str) -> int:
        return df.select(F.max(F.array_max(tokens))).first()[0]

    @staticmethod
    def long(df: DataFrame, id: str, tokens: str) -> DataFrame:
        """(id, token, n), without zeros."""
        return df.select(id, F.explode(tokens).alias("token")).where("token >= 0").groupBy(id, "token").agg(F.count(F.lit(1)).alias("n"))

    @staticmethod
    def fit_transform(df: DataFrame, tokens: str, output: str, max_token_id: int | None = None) -> DataFrame:
        """A dense row of max_token_id + 1 counts a document, made within the row."""
        top = CountVectorizer.max_token_id(df, tokens) if max_token_id is None else max_token_id
        zeros = F.array_repeat(F.lit(0), top + 1)
        used = F.filter(F.col(tokens), lambda t: (t >= 0) & (t <= top))
        counts = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda k: F.size(F.filter(used, lambda t: t == k)))
        return df.withColumn(output, F.when(F.size(used) == 0, zeros).otherwise(counts))


# Short forms of the above.
def standard_scale(df: DataFrame, cols: list[str], **opts) -> DataFrame:
    return StandardScaler.fit_transform(df, cols, **opts)


def max_abs_scale(df: DataFrame, cols: list[str], **opts) -> DataFrame:
    return MaxAbsScaler.fit_transform(df, cols, **opts)


def min_max_scale(df: DataFrame, cols: list[str], **opts) -> DataFrame:
    return MinMaxScaler.fit_transform(df, cols, **opts)


def binarize(df: DataFrame, cols: list[str], threshold: float = 0.0, type: str = "float") -> DataFrame:
    return Binarizer.fit_transform(df, cols, threshold, type)


def ordinal_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return OrdinalEncoder.fit_transform(df, column, output)


def one_hot_encode(df: DataFrame, column: str, output: str, num_categories: int | None = None) -> DataFrame:
    return OneHotEncoder.fit_transform(df, column, output, num_categories)


def normalize(df: DataFrame, cols: list[str], **opts) -> DataFrame:
    return Normalizer.fit_transform(df, cols, **opts)


def normalize_rows(df: DataFrame, features: str, norm: str = "euclidean") -> DataFrame:
    """An array column divided by its norm."""
    return df.withColumn(features, vectors.normalized(features, norm))


@dataclass(frozen=True)
class SimpleImputerModel:
    statistics: dict[str, object]
    missing: float | None

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(missing(c, self.missing), F.lit(v)).otherwise(F.col(c)) for c, v in self.statistics.items()})


def missing(c: str, value: float | None = None) -> Column:
    """Null, NaN, or a stand-in value where one is given."""
    if value is not None:
        return F.col(c).isNull() | (F.col(c) == F.lit(value))
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


class SimpleImputer:
    @staticmethod
    def fit(df: DataFrame, cols: list[str], strategy: str = "mean", missing_values: float | None = None, fill_value: float = 0.0) -> SimpleImputerModel:
        """mean, median (exact), mode (the smallest of equally frequent values) or constant of each column."""
        V.one_of(strategy, ("mean", "median", "mode", "constant"))
        if strategy == "constant":
            return SimpleImputerModel(dict.fromkeys(cols, fill_value), missing_values)
        known = lambda c: F.when(~missing(c, missing_values), F.col(c))
        if strategy == "median":
            return SimpleImputerModel({c: v[0] for c, v in quantiles(df, {c: known(c) for c in cols}, [0.5]).items()}, missing_values)
        expr = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}[strategy]
        return SimpleImputerModel(_stats(df, {c: expr(known(c)) for c in cols}), missing_values)
