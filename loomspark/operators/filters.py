"""Coercions and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import percentiles, with_groups

#: Texts that stand for a missing one.
SENTINELS = ("", "[]", "nan", "None", "none", "NaN")


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def to_bool(c: Column) -> Column:
    """true/1 and false/0 in any case; anything else is null."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))


def without_sentinels(df: DataFrame, column: str, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.trim(column).isin(*sentinels))


def select_existing(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The listed columns that exist, and the names of those that don't."""
    return df.select(*[c for c in columns if c in df.columns]), [c for c in columns if c not in df.columns]


def mapped(c: Column, values: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def length_band(df: DataFrame, column: str, low: int, high: int, by: str) -> DataFrame:
    """Rows of each group within the band; a group without any keeps all of its rows.

    The counts are a partial aggregate and a join on the group, so no group's rows meet in one task.
    """
    inside = F.char_length(column).between(low, high)
    some = df.groupBy(by).agg(F.max(inside).alias("_some"))
    return with_groups(df, some, [by]).where(inside | ~F.coalesce("_some", F.lit(False))).drop("_some")


def dynamic_minimum(df: DataFrame, value: Column, by: str, floor: float) -> DataFrame:
    """Rows whose value is at least max(floor, median - standard deviation) of its group."""
    rows = df.withColumn("_value", value)
    spread = rows.groupBy(by).agg(F.coalesce(F.stddev_samp("_value"), F.lit(0.0)).alias("_spread"))
    cut = with_groups(percentiles(rows, "_value", (0.5,), [by]), spread, [by]).select(by, F.greatest(F.lit(float(floor)), F.col("p")[0] - F.col("_spread")).alias("_cut"))
    return with_groups(rows, cut, [by]).where(F.col("_value") >= F.col("_cut")).drop("_value", "_cut")


def above_quantile(df: DataFrame, column: str, q: float, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    cut = percentiles(df, column, (q,), by).select(*by, F.col("p")[0].alias("_cut"))
    return with_groups(df, cut, by).where(F.col(column) > F.col("_cut") if strict else F.col(column) >= F.col("_cut")).drop("_cut")


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; a None is no filter (so False filters for False)."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def contains_any(columns: Sequence[str], needle: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(needle.lower()), F.lit(False))
    return out


def active(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted_at).isNull())


def expired(df: DataFrame, now: Column, expires_at: str = "expires_at") -> DataFrame:
    return df.where(F.col(expires_at) < now)
