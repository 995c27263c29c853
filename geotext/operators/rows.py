"""Row-wise and key-wise operators over (key, value) tables and single columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from geotext.operators.skew import attach


def map_to(df: DataFrame, column: str, f: Callable[[Column], Column], name: str) -> DataFrame:
    """Pair each item with ``f(item)``."""
    return df.withColumn(name, f(F.col(column)))


def map_to_value(df: DataFrame, value, name: str) -> DataFrame:
    """Pair each item with a value; a Column such as ``rand()`` is evaluated per row."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def map_keys(df: DataFrame, f: Callable[[Column], Column], key: str = "key") -> DataFrame:
    return df.withColumn(key, f(F.col(key)))


def map_values(df: DataFrame, f: Callable[[Column], Column], value: str = "value") -> DataFrame:
    return df.withColumn(value, f(F.col(value)))


def map_columns(
    df: DataFrame, columns: Sequence[str], f: Callable[..., Column], name: str
) -> DataFrame:
    """Apply ``f`` to several columns at once."""
    return df.select(f(*[F.col(c) for c in columns]).alias(name))


def counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Occurrences of each distinct item."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def ungroup(df: DataFrame, keys: Sequence[str], items: str, name: str) -> DataFrame:
    """One row per item of an array; an empty array gives none."""
    return df.select(*keys, F.explode(items).alias(name))


def average(df: DataFrame, column: str, group: Sequence[str] = (), name: str = "avg") -> DataFrame:
    """Mean per group, NULL where there is nothing to average."""
    return df.groupBy(*group).agg(F.avg(column).alias(name))


def normalize(df: DataFrame, column: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Divide each value by the total, of the table or of its group; NULL if that is zero."""
    value = F.col(column).cast("double")
    if not group:
        total = df.agg(F.sum(value)).scalar()
        return df.withColumn(name, F.try_divide(value, total))
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    return (
        attach(df, totals, list(group), null_safe=True, count="_rows")
        .withColumn(name, F.try_divide(value, F.col("_total")))
        .drop("_total", "_rows")
    )


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A random order that depends only on the key and the seed, not on the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
