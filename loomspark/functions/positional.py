"""Operators on the order of tokens in an array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """0 .. n - 1, empty where n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def thirds(toks: Column, head: float = 0.2, tail: float = 0.8) -> Column:
    """Struct of the first 20, middle 60 and last 20 percent; bounds are cut towards zero."""
    n = F.size(toks)
    a, b = F.floor(n * head).cast("int"), F.floor(n * tail).cast("int")
    return F.struct(F.slice(toks, F.lit(1), a).alias("inicio"), F.slice(toks, a + 1, b - a).alias("meio"), F.slice(toks, b + 1, n - b).alias("fim"))


def ngrams(toks: Column, n: int, glue: str = " ") -> Column:
    return let(toks, lambda t: F.transform(indices(F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), glue)))


def has_run(toks: Column, n: int = 3) -> Column:
    """Are there ``n`` equal tokens in a row?"""
    return let(toks, lambda t: F.exists(indices(F.size(t) - (n - 1)), lambda i: F.size(F.array_distinct(F.slice(t, i + 1, F.lit(n)))) == 1))


def shifted(df: DataFrame, toks: Column, by: Sequence[str], width: int) -> DataFrame:
    """(by, _i, _n, _0 .. _width): one row for each token of a row, with its place, the number of tokens, and those that follow it (null: none).

    The token array is zipped with itself shifted, so pairs and n-grams are plain columns of one row.
    """
    rows = df.select(*by, toks.alias("_t"))
    zipped = F.arrays_zip(*[(F.slice("_t", F.lit(k + 1), F.greatest(F.size("_t"), F.lit(1))) if k else F.col("_t")).alias(f"_{k}") for k in range(width + 1)])
    return rows.select(*by, F.size("_t").alias("_n"), F.posexplode(zipped).alias("_i", "_z")).select(*by, "_i", "_n", *[F.col(f"_z.{k}").alias(k) for k in (f"_{j}" for j in range(width + 1))])


def window_pairs(df: DataFrame, toks: Column, by: Sequence[str] = (), width: int = 5) -> DataFrame:
    """(by, a, b): sorted pairs of different tokens at most ``width`` apart, repeats included."""
    pairs = F.array(*[F.struct(F.least("_0", f"_{k}").alias("a"), F.greatest("_0", f"_{k}").alias("b")) for k in range(1, width + 1)])
    return shifted(df, toks, by, width).select(*by, F.inline(pairs)).where("a <> b")


def ngram_rows(df: DataFrame, toks: Column, by: Sequence[str] = (), sizes: Sequence[int] = (2,)) -> DataFrame:
    """(by, term): all n-grams of the given sizes."""
    terms = F.array(*[F.when(F.col(f"_{n - 1}").isNotNull(), F.concat_ws(" ", *[f"_{k}" for k in range(n)])) for n in sizes])
    return shifted(df, toks, by, max(sizes) - 1).select(*by, F.explode(terms).alias("term")).where("term is not null")


def max_repeat(toks: Column) -> Column:
    """How often the commonest token occurs (0: no token); linear after a sort."""
    ordered = F.array_sort(toks)
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(t == s["last"], s["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(ordered, zero, step, lambda s: s["best"])
