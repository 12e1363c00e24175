"""Profiles: metric specifications compiled into one long table for each group and the whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from ..session import stored

#: Shares of the percentile battery, and the statistics of a number in the order of the report.
BATTERY = (0.1, 0.25, 0.5, 0.75, 0.9)
STATISTICS = ("n", "nulos", "mean", "std", "min", "max", "zeros", "negatives", "skew", "kurtosis", "cv", *[f"p{round(100 * q)}" for q in BATTERY], "iqr", "outliers")


def long_profile(df: DataFrame, by: str, numbers: Mapping[str, Column], flags: Mapping[str, Column] | None = None, categories: Mapping[str, Column] | None = None, top: int = 10, whole: str = "(todos)") -> DataFrame:
    """(grupo, secao, campo, chave, valor): the profile of every group of ``by`` and of the whole table.

    Sections: ``numero`` has the STATISTICS of each number, ``sinal`` the rows, the true ones and their percentage of each flag,
    ``categoria`` the counts of the ``top`` commonest values of each category (ties: the smaller) and ``dominante`` (the place of the
    commonest is 1). The expressions are worked out once and stored; all fields of a section are one
    table (group, field, value), so that the number of jobs does not grow with the fields. A null group is a group; nulls and NaN
    are no values and are counted as ``nulos``; an outlier lies beyond 1.5 times the spread of the quartiles.
    """
    flags, categories = flags or {}, categories or {}
    pack = lambda specs, kind: F.array(*[F.struct(F.lit(n).alias("campo"), c.cast(kind).alias("valor")) for n, c in specs.items()]) if specs else F.array().cast(f"array<struct<campo:string,valor:{kind}>>")
    rows = df.select(F.col(by).cast("string").alias("grupo"), pack(numbers, "double").alias("_numbers"), pack(flags, "boolean").alias("_flags"), pack(categories, "string").alias("_categories"))
    rows = stored(rows, "profile").withColumn("grupo", F.explode(F.array("grupo", F.lit(whole))))
    key = ["grupo", "campo"]
    values = rows.select("grupo", F.inline("_numbers")).withColumn("valor", F.when(~F.isnan("valor"), F.col("valor")))
    described = stats.describe(values, "valor", key)
    battery = stats.percentiles(values, "valor", BATTERY, key)
    edges = battery.select(*key, (F.col("p")[1] - 1.5 * (F.col("p")[3] - F.col("p")[1])).alias("_low"), (F.col("p")[3] + 1.5 * (F.col("p")[3] - F.col("p")[1])).alias("_high"))
    beyond = stats.with_groups(values, edges, key).groupBy(*key).agg(F.count_if(~F.col("valor").between(F.col("_low"), F.col("_high"))).alias("outliers"))
    empty = values.groupBy(*key).agg(F.count_if(F.col("valor").isNull()).alias("nulos"))
    found = described
    for part in (battery, beyond, empty):
        found = stats.with_groups(found, part, key, "left")
    found = found.withColumns({f"p{round(100 * q)}": F.col("p")[i] for i, q in enumerate(BATTERY)})
    numbered = found.select(F.lit("numero").alias("secao"), *key, F.inline(F.array(*[F.struct(F.lit(s).alias("chave"), F.col(s).cast("double").alias("valor")) for s in STATISTICS])))
    signs = rows.select("grupo", F.inline("_flags")).groupBy(*key).agg(F.count("*").cast("double").alias("n"), F.count_if("valor").cast("double").alias("sim"))
    signs = signs.withColumn("pct", 100 * F.col("sim") / F.col("n")).select(F.lit("sinal").alias("secao"), *key, F.inline(F.array(*[F.struct(F.lit(s).alias("chave"), F.col(s).alias("valor")) for s in ("n", "sim", "pct")])))
    counts = rows.select("grupo", F.inline("_categories")).where("valor is not null").groupBy(*key, "valor").agg(F.count("*").alias("n"))
    ranked = stats.top_rows(counts, key, [F.desc("n"), F.asc("valor")], top, rank="place")
    kinds = ranked.select(F.lit("categoria").alias("secao"), *key, F.col("valor").alias("chave"), F.col("n").cast("double").alias("valor"))
    leading = ranked.where("place = 1").select(F.lit("dominante").alias("secao"), *key, F.col("valor").alias("chave"), F.lit(1.0).alias("valor"))
    out = numbered.unionByName(signs).unionByName(kinds).unionByName(leading)
    return out.select("grupo", "secao", "campo", "chave", "valor")


def write_profile(profile: DataFrame, path: str) -> None:
    """One folder for each group, as the report of a niche is read by itself."""
    profile.write.mode("overwrite").partitionBy("grupo").parquet(path)


def compared(profile: DataFrame, a: str, b: str, statistics: Sequence[str] = ("p50", "mean", "pct")) -> DataFrame:
    """(campo, chave, a, b, delta): two groups of a profile side by side, largest relative difference first."""
    side = lambda g: F.max(F.when(F.col("grupo") == g, F.col("valor")))
    out = profile.where(F.col("chave").isin(*statistics)).groupBy("campo", "chave").agg(side(a).alias("a"), side(b).alias("b"))
    relative = F.try_divide(F.abs(F.col("a") - F.col("b")), F.greatest(F.abs("a"), F.abs("b")))
    return out.withColumn("delta", F.col("a") - F.col("b")).orderBy(F.desc_nulls_last(relative), "campo", "chave")
