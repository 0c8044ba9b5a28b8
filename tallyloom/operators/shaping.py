"""Result shaping: unpivot, pivot, average and sort, caps, append, names, series analysis."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import DECIMAL
from ..functions.buckets import LABEL, bucket, bucket_list, instant, shift
from ..model import TimeRange, Unit


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "agg_name", value: str = "value") -> DataFrame:
    """Each metric column becomes rows (name, value); values are decimals."""
    if len({*columns}) < len(columns):
        raise ValueError("a column is given twice")
    ids = [c for c in df.columns if c not in columns]
    return df.withColumns({c: F.col(c).cast(DECIMAL) for c in columns}).unpivot(ids, list(columns), name, value)


def pivot(df: DataFrame, name: str, value: str, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """name's values become the given columns, in this order; missing ones are null. strict: another value is an error."""
    if strict:
        df = df.withColumn(name, F.when(F.col(name).isin(*columns), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("no column for "), F.col(name)))))
    ids = [c for c in df.columns if c not in (name, value)]
    return df.groupBy(*ids).pivot(name, list(columns)).agg(F.first(value))


def pivot_time(df: DataFrame, time: TimeRange, unit: Unit, value: str = "value") -> DataFrame:
    labels = [t.strftime(LABEL) for t in bucket_list(time, unit)]
    named = df.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss"))
    return pivot(named.where(F.col("bucket").isin(*labels)), "bucket", value, labels)


def average_and_sort(df: DataFrame, dims: int, name: str = "Average") -> DataFrame:
    """Column name, after the first dims columns: mean of the others, nulls as 0; rows by it, greatest first."""
    values = df.columns[dims:]
    mean = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in values)) / len(values)
    out = df.select(*[F.col(f"`{c}`") for c in df.columns[:dims]], mean.alias(name), *[F.col(f"`{c}`") for c in values])
    return out.orderBy(F.desc_nulls_last(name))


def limit_groups(df: DataFrame, columns: Sequence[str], order: Sequence[Column], limit: int = 50) -> DataFrame:
    """Keeps a row if, for every given column, it is among the first limit of its value."""
    if not columns:
        return df
    ranks = [F.row_number().over(Window.partitionBy(c).orderBy(*order)).alias(f"_rank_{i}") for i, c in enumerate(columns)]
    kept = df.select("*", *ranks)
    for i in range(len(columns)):
        kept = kept.where(F.col(f"_rank_{i}") <= limit)
    return kept.drop(*[f"_rank_{i}" for i in range(len(columns))])


def add_string(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.lit(value).alias(name), "*")


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def rename_rows(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Maps the column's values; others stay."""
    return df.replace(names, subset=[column]) if names else df


def append(parts: Sequence[tuple[str, DataFrame]], name: str = "event") -> DataFrame:
    """Tables one after the other, each under its name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (add_string(df, name, n) for n, df in parts))


def dense(df: DataFrame, value: str, series: Sequence[str], buckets: Sequence[datetime], time: str = "bucket") -> DataFrame:
    """A row for each series and bucket; buckets that had none have the value 0."""
    each = df.select(*series).distinct().withColumn(time, F.explode(F.array(*[instant(t) for t in buckets])))
    names = {c: f"_s_{c}" for c in (*series, time)}
    known = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], value)
    on = reduce(lambda a, b: a & b, (F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in names.items()))
    return each.join(known, on, "left").select(*[c if c != value else F.coalesce(value, F.lit(0)).alias(value) for c in df.columns])


def analyse(df: DataFrame, how: str, value: str, series: Sequence[str], buckets: Sequence[datetime], window: int = 2, time: str = "bucket") -> DataFrame:
    """value as a cumulative sum, rolling average over window buckets, natural logarithm (of positive values), or as it is.

    Sums and averages run over all buckets, of which those without a row count as 0."""
    order = Window.partitionBy(*series).orderBy(time)
    if how in ("cumulative", "rolling_average"):
        df = dense(df, value, series, buckets, time)
    done = {
        "linear": lambda: F.col(value), "logarithmic": lambda: F.when(F.col(value) > 0, F.log(F.col(value))),
        "cumulative": lambda: F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)), "rolling_average": lambda: F.avg(value).over(order.rowsBetween(1 - window, 0)),
    }[how]()
    return df.withColumn(value, done)


def compare(df: DataFrame, earlier: DataFrame, value: str, series: Sequence[str], offset: int, unit: Unit, grain: Unit, time: str = "bucket") -> DataFrame:
    """Adds compare_value: the value in earlier, the same series over the time offset units before; null where there is none."""
    at = bucket(shift(F.col(time), offset, unit), grain)
    before = earlier.select(*[F.col(f"`{s}`").alias(f"_s_{s}") for s in series], at.alias("_t"), F.col(value).alias("compare_value"))
    on = [F.col(f"`{s}`").eqNullSafe(F.col(f"`_s_{s}`")) for s in series] + [F.col(time) == F.col("_t")]
    return df.join(before, on, "left").drop(*[f"_s_{s}" for s in series], "_t")


def encode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replaces text by its key; unknown text by null."""
    d = dictionary.select(F.col("value").alias("_value"), F.col("key").alias("_key"))
    return _swap(df.join(d, df[column] == d["_value"], "left"), column, "_key", "_value")


def decode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replaces keys by their text, nulls stay; Spark broadcasts the dictionary if its size allows."""
    d = dictionary.select(F.col("value").alias("_value"), F.col("key").alias("_key"))
    return _swap(df.join(d, df[column] == d["_key"], "left"), column, "_value", "_key")


def _swap(df: DataFrame, column: str, by: str, other: str) -> DataFrame:
    return df.select(*[F.col(by).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns if c not in (by, other)])
