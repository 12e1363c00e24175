"""Descriptive statistics, shares, histograms, correlation and regression by group.

Statistics are single aggregates with partial sums where the function allows it. Values that depend
on a group statistic are joined back on the group instead of being windowed over all of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import file_bytes, parts_of

#: Groups with sketches of their own (the largest ones), their least rows, and the accuracy of a sketch.
HEAVY_GROUPS, HEAVY_ROWS, ACCURACY = 10_000, 200_000, 20_000
#: Values whose ranks are broadcast (the commonest ones); bytes of files for one range of values, and the least number of ranges.
COMMON_VALUES, RANGE_BYTES, RANGES = 10_000, 8 << 20, 64


def with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of ``groups`` (one row a group, a null key is a group); without keys ``groups`` is one row.

    Adaptive execution broadcasts the groups where they turn out small; nothing runs while the plan is made.
    """
    if not by:
        return df.crossJoin(F.broadcast(groups))
    other = groups.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], *[c for c in groups.columns if c not in by])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(by)])
    return df.join(other, same, how).drop(*[f"_by{i}" for i in range(len(by))])


def _keyed(df: DataFrame, by: Sequence[str], *columns: Column) -> tuple[DataFrame, list[str]]:
    """``df`` as (keys, columns) with keys of names that clash with nothing; a constant stands for no keys."""
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)] or [F.lit(0).alias("_k0")]
    return df.select(*keys, *columns), [f"_k{i}" for i in range(len(keys))]


def _unkeyed(df: DataFrame, by: Sequence[str], *columns: Column | str) -> DataFrame:
    return df.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(by)], *columns)


def _with_heavy(rows: DataFrame, heavy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with what ``heavy`` (at most HEAVY_GROUPS rows, so it can be broadcast) has of their group, else nulls."""
    return with_groups(rows, F.broadcast(heavy), keys, "left")


def percentiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, p): exact percentiles with linear interpolation, in the order of ``shares``. A null key is a group; nulls and NaN are no values.

    Two scans and no group in one task. The first sketches the largest groups: a mergeable quantile sketch
    gives values between which each wanted rank must lie. The second counts what lies outside and
    keeps only the values inside, about 4 / ACCURACY of a group for each share. Groups below
    HEAVY_ROWS, or beyond the HEAVY_GROUPS largest, keep their values. A rank that its bracket misses is an error, not a wrong result.
    """
    order = sorted(range(len(shares)), key=lambda i: shares[i])
    x = F.col(column).cast("double")
    rows, keys = _keyed(df, by, x.alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    low, high = ([min(1.0, max(0.0, shares[i] + d / ACCURACY)) for i in order] for d in (-2, 2))
    edges = lambda points: F.percentile_approx("_x", F.array(*map(F.lit, points)), F.lit(ACCURACY))
    heavy = rows.groupBy(*keys).agg(F.count("*").alias("_rows"), edges(low).alias("_low"), edges(high).alias("_high"))
    heavy = heavy.where(F.col("_rows") >= HEAVY_ROWS).orderBy(F.desc("_rows"), *keys).limit(HEAVY_GROUPS).drop("_rows")
    slot = F.coalesce(F.size(F.filter("_high", lambda e: e < F.col("_x"))), F.lit(0))
    inside = F.col("_low").isNull() | F.coalesce(F.get("_low", F.col("_slot")) <= F.col("_x"), F.lit(False))
    marked = _with_heavy(rows, heavy, keys).withColumn("_slot", F.when(F.col("_low").isNull(), 0).otherwise(slot)).withColumn("_v", F.when(inside, F.col("_x")))
    counts = marked.groupBy(*keys, "_slot", "_v").agg(F.count("*").alias("_n"))
    # Rows outside stand before the bracket they are below, so this order is that of the values.
    line = Window.partitionBy(*keys).orderBy("_slot", F.asc_nulls_first("_v"))
    before = F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"_before": before, "_total": F.sum("_n").over(Window.partitionBy(*keys))})
    value = F.when(F.col("_v").isNull(), F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")).otherwise(F.col("_v"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), value))

    aggs = []
    for i, q in enumerate(shares):
        k = F.lit(float(q)) * (F.col("_total") - 1)
        aggs += [at(F.floor(k)).alias(f"_lo{i}"), at(F.ceil(k)).alias(f"_hi{i}"), F.max(k - F.floor(k)).alias(f"_part{i}")]
    found = placed.groupBy(*keys).agg(*aggs)
    return _unkeyed(found, by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}") for i in range(len(shares))]).alias("p"))


def median_of(df: DataFrame, values: dict[str, Column], by: Sequence[str]) -> DataFrame:
    """(by, name...): the exact medians of several expressions, all from one pass of ``percentiles``; groups without a value have nulls."""
    names = list(values)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), c.cast("double").alias("_value")) for n, c in values.items()])).alias("_s")).select(*by, "_s.*")
    p = percentiles(long, "_value", (0.5,), [*by, "_name"])
    groups = p.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("p")[0])).alias(n) for n in names])
    return with_groups(df.select(*by).distinct(), groups, by, "left") if by else groups


def ranked_values(rows: DataFrame, keys: Sequence[str], weights: Sequence[Column], parts: int = RANGES) -> DataFrame:
    """(keys, _x, _n, centred): of each value of ``_x`` its largest weight and the average ranks less their mean, one for every weight column.

    Values are counted, the counted ones dealt into ``parts`` ranges (by sketches of the largest groups, the others are one
    range), summed up within a range, and a small table holds what the ranges before it add. So no
    large group meets in one task, and the result does not depend on where the ranges end.
    """
    names = [f"_w{i}" for i in range(len(weights))]
    counts = rows.groupBy(*keys, "_x").agg(*[F.sum(w).alias(n) for n, w in zip(names, weights, strict=True)])
    heavy = counts.groupBy(*keys).agg(F.count("*").alias("_rows"), F.percentile_approx("_x", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(max(1000, 10 * parts))).alias("_edges"))
    heavy = heavy.where(F.col("_rows") >= HEAVY_ROWS).orderBy(F.desc("_rows"), *keys).limit(HEAVY_GROUPS).drop("_rows")
    step = math.isqrt(parts)
    heavy = heavy.withColumn("_last", F.filter("_edges", lambda e, i: (i + 1) % step == 0))  # of every ``step`` edges
    below = lambda edges: F.size(F.filter(edges, lambda e: e < F.col("_x")))
    dealt_out = _with_heavy(counts, heavy, keys).withColumn("_steps", step * below("_last"))
    part = F.col("_steps") + below(F.slice("_edges", F.col("_steps") + 1, F.lit(step)))
    counts = dealt_out.withColumn("_part", F.when(F.col("_edges").isNull(), 0).otherwise(part)).drop("_edges", "_last", "_steps")
    sums = counts.groupBy(*keys, "_part").agg(*[F.sum(n).alias(n) for n in names])  # at most ``parts`` rows a group
    behind = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = Window.partitionBy(*keys).orderBy("_part")
    bases = sums.select(*keys, "_part", *[(behind(line, n) - (F.sum(n).over(Window.partitionBy(*keys)) + 1) / 2).alias(f"_base{n}") for n in names])
    within = Window.partitionBy(*keys, "_part").orderBy("_x")
    inside = counts.withColumns({f"_in{n}": behind(within, n) for n in names})
    out = with_groups(inside, bases, [*keys, "_part"])
    most = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return out.select(*keys, "_x", most.alias("_n"), F.array(*[F.col(f"_base{n}") + F.col(f"_in{n}") + (F.col(n) + 1) / 2 for n in names]).alias("centred"))


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, sample deviation, extremes, quartiles, spread, zeros and negatives, bias-adjusted skewness and kurtosis."""
    x, n = F.col(column).cast("double"), F.col("n").cast("double")
    agg = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"),
    )
    p = percentiles(df, column, (0.25, 0.5, 0.75), by)
    agg = with_groups(agg, p, by, "left") if by else agg.join(p, F.lit(True), "left")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    p = F.col("p")
    return agg.withColumns({"median": p[1], "q1": p[0], "q3": p[2], "iqr": p[2] - p[0], "skew": skew, "kurtosis": kurt, "cv": F.try_divide(F.col("std"), F.col("mean")) * 100}).drop("g1", "g2", "p")


def tukey(df: DataFrame, column: str, by: Sequence[str], top: int = 3) -> DataFrame:
    """Fences, number and share of outliers, and the ``top`` largest values of each group."""
    low, high = (F.col("p")[0] - 1.5 * (F.col("p")[1] - F.col("p")[0])).alias("low"), (F.col("p")[1] + 1.5 * (F.col("p")[1] - F.col("p")[0])).alias("high")
    q = percentiles(df, column, (0.25, 0.75), by).select(*by, low, high)
    out = with_groups(df.select(*by, column), q, by).groupBy(*by, "low", "high").agg(
        F.count(column).alias("n"), F.count_if((F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).alias("outliers")
    )
    largest = top_rows(df.select(*by, column).where(F.col(column).isNotNull()), by, [F.desc(column)], top).groupBy(*by).agg(F.reverse(F.array_sort(F.collect_list(column))).alias("largest"))
    out = with_groups(out, largest, by)  # both have a row for each group
    return out.withColumn("share", F.round(100.0 * F.col("outliers") / F.col("n"), 4))


def box_plot(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The five numbers behind a box plot, and how many values lie beyond the whiskers: (q1, median, q3, low, high, beyond)."""
    q = percentiles(df, column, (0.25, 0.5, 0.75), by)
    x, p = F.col(column).cast("double"), F.col("p")
    inside = x.between(p[0] - 1.5 * (p[2] - p[0]), p[2] + 1.5 * (p[2] - p[0]))
    out = with_groups(df.select(*by, column).where(F.col(column).isNotNull()), q, by).groupBy(*by, "p")
    out = out.agg(F.min(F.when(inside, x)).alias("low"), F.max(F.when(inside, x)).alias("high"), F.count_if(~inside).alias("beyond"))
    return out.select(*by, p[0].alias("q1"), p[1].alias("median"), p[2].alias("q3"), "low", "high", "beyond")


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group. The rank filter is applied before the shuffle too."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: nulls (and blanks), share, and OK, ATENCAO (up to 10 %) or CRITICO."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    one = df.agg(F.count("*").alias("n"), *[F.count_if(empty(c)).alias(f"{c}_") for c in columns])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(f"{c}_").alias("vazios")) for c in columns])).alias("r")).select("n", "r.*")
    share = F.coalesce(F.try_divide(100.0 * F.col("vazios"), F.col("n")), F.lit(0.0))
    return rows.select("coluna", "n", "vazios", F.round(share, 4).alias("percentual"), F.when(share == 0, "OK").when(share <= 10, "ATENCAO").otherwise("CRITICO").alias("status"))


def shares(df: DataFrame, conditions: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage of rows for which each condition holds."""
    aggs = [a for k, c in conditions.items() for a in (F.count_if(c).alias(f"n_{k}"), F.round(100.0 * F.count_if(c) / F.count("*"), 4).alias(f"pct_{k}"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def mode(column: str | Column) -> Column:
    """Commonest value without nulls, ties to the smallest."""
    return F.mode(column, deterministic=True)


def counts_in_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts by category in the given order; categories that don't occur are left out."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.where(F.col(column).isin(*order)).groupBy(column).agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0, list(values))


def unpivot_top(df: DataFrame, key: str, values: Sequence[str], k: int) -> DataFrame:
    long = df.unpivot([key], list(values), "coluna", "n")
    return long.orderBy(F.desc("n"), key, "coluna").limit(k)


def crosstab_percent(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and column as percentages of the row."""
    wide = pivot_counts(df, row, column, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select(row, *[F.round(F.coalesce(F.try_divide(100.0 * F.col(v), total), F.lit(0.0)), 4).alias(v) for v in values])


def rank_correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, n, r): rank correlation of every two columns (by position), each over the rows that have both.

    Equal rows are one with a weight. All columns are ranked in one long table, a rank for each other column that the row has too.
    Rows lie in partitions of a size, by row, and stay there: the ranks of the commonest values are broadcast, so that no frequent
    value meets in one task; only the other values of a row are joined with their ranks, which come back to it. One aggregate
    sums up the products of all pairs.
    """
    k = len(columns)
    rows, keys = _keyed(df, by, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    given = [F.col(f"_c{i}").isNotNull() & ~F.isnan(f"_c{i}") for i in range(k)]
    rows = rows.select(*keys, *[F.when(g, F.col(f"_c{i}") + 0.0).alias(f"_c{i}") for i, g in enumerate(given)])  # no negative zero
    marked = [x for c in (*keys, *[f"_c{i}" for i in range(k)]) for x in (F.col(c).isNull(), F.col(c))]  # a hash alone skips nulls
    row = ["_row0", "_row1"]  # 128 bits
    parts = parts_of(df)
    rows = rows.select("*", *[F.xxhash64(F.lit(seed), *marked).alias(r) for seed, r in enumerate(row)]).repartition(parts, *row)
    rows = rows.groupBy(*row, *keys, *[f"_c{i}" for i in range(k)]).agg(F.count("*").alias("_w"))
    entries = F.filter(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(f"_c{i}").alias("_x")) for i in range(k)]), lambda s: s["_x"].isNotNull())
    long = rows.select(*keys, "_w", F.array(*[F.col(f"_c{i}").isNotNull() for i in range(k)]).alias("_has"), F.inline(entries))
    ranges = max(RANGES, math.ceil(file_bytes(df) / RANGE_BYTES))
    ranks = ranked_values(long, [*keys, "_col"], [F.when(F.get("_has", F.lit(i)), F.col("_w")).otherwise(0) for i in range(k)], ranges)
    common = ranks.orderBy(F.desc("_n"), *keys, "_col", "_x").limit(COMMON_VALUES)
    wide = rows
    for i in range(k):
        own = common.where(F.col("_col") == i).select(*keys, F.col("_x").alias(f"_c{i}"), F.col("centred").alias(f"_r{i}"))
        wide = with_groups(wide, F.broadcast(own), [*keys, f"_c{i}"], "left")
    others = F.filter(F.array(*[F.struct(F.lit(i).alias("_col"), F.when(F.col(f"_r{i}").isNull(), F.col(f"_c{i}")).alias("_x")) for i in range(k)]), lambda s: s["_x"].isNotNull())
    found = with_groups(wide.select(*row, *keys, F.inline(others)), ranks.drop("_n"), [*keys, "_col", "_x"]).select(*row, "_col", "centred")
    found = found.repartition(parts, *row).groupBy(*row).agg(*[F.max(F.when(F.col("_col") == i, F.col("centred"))).alias(f"_s{i}") for i in range(k)])
    wide = wide.join(found, row, "left").select(*keys, "_w", *[F.coalesce(f"_r{i}", f"_s{i}").alias(f"_r{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    entry = lambda i, j: F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j"), F.get(f"_r{i}", F.lit(j)).alias("_p"), F.get(f"_r{j}", F.lit(i)).alias("_q"))
    each = wide.select(*keys, "_w", F.inline(F.array(*[entry(i, j) for i, j in pairs]))).where("_p is not null and _q is not null")
    product = lambda a, b: F.sum(F.col("_w") * F.col(a) * F.col(b))
    r = F.try_divide(product("_p", "_q"), F.sqrt(product("_p", "_p") * product("_q", "_q")))
    found = each.groupBy(*keys, "_i", "_j").agg(F.sum("_w").alias("n"), r.alias("r"))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    return _unkeyed(found, by, name("_i").alias("a"), name("_j").alias("b"), "n", "r")


def _strength(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.7, "forte").when(F.abs(r) >= 0.4, "moderada").otherwise("fraca")


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of rows where both values are there: n, r, t, and the strength by |r|. A null key is a group."""
    out = rank_correlations(df, [a, b], by).drop("a", "b")
    t = F.try_divide(F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))), F.sqrt(1 - F.least(F.col("r") * F.col("r"), F.lit(1.0))))
    return out.withColumns({"t": t, "strength": _strength(F.col("r"))})


def t_tail(t: np.ndarray, free: np.ndarray, steps: int = 300) -> np.ndarray:
    """Two-sided tail of Student's t: the regularised incomplete beta function by Lentz's continued fraction."""
    out = np.full(len(t), np.nan)
    for i, (v, f) in enumerate(zip(t, free, strict=True)):
        if not (np.isfinite(v) and f > 0):
            continue
        x, a, b = f / (f + v * v), f / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
        turned = x > (a + 1) / (a + b + 2)
        p, q, y = (b, a, 1 - x) if turned else (a, b, x)
        c, d = 1.0, 1 / ((1 - (p + q) * y / (p + 1)) or 1e-300)
        h = d
        for m in range(1, steps):
            for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / ((1 + k * d) or 1e-300)
                c = (1 + k / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        share = front * h / p
        out[i] = 1 - share if turned else share
    return out


def spearman_test(df: DataFrame, a: str, b: str, by: Sequence[str] = (), least: int = 5, level: float = 0.05) -> DataFrame:
    """``spearman`` of groups of at least ``least`` rows with the two-sided p-value and whether it is below ``level``."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, free: pd.Series) -> pd.Series:  # one value a group
        return pd.Series(t_tail(t.to_numpy(float), free.to_numpy(float)))

    out = spearman(df, a, b, by).where(F.col("n") >= least).withColumn("p", p_value(F.col("t"), F.col("n") - 2))
    return out.withColumn("significant", F.coalesce(F.col("p") < level, F.abs("r") == 1))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, r, strength) of every two columns (a before b), each over the rows that have both, strongest first."""
    out = rank_correlations(df, columns).withColumn("strength", _strength(F.col("r")))
    return out.orderBy(F.desc_nulls_last(F.abs("r")), "a", "b")


def ols(df: DataFrame, y: Column, x: Column, by: Sequence[str]) -> DataFrame:
    rows = df.select(*by, y.cast("double").alias("_y"), x.cast("double").alias("_x"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the extremes; the last bin is closed."""
    edges = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1 over the whole table (0 where all values are equal)."""
    edges = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(edges))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        out = out.withColumn(c, F.coalesce(F.try_divide((F.col(c) - lo).cast("double"), hi - lo), F.lit(0.0)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def month_counts(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(F.date_format(at, "yyyy-MM").alias("mes")).agg(F.count("*").alias("n"))


def with_share(df: DataFrame, n: str = "n", digits: int = 0) -> DataFrame:
    """Percentage of the total and share of the largest, over an already aggregated table."""
    total = df.agg(F.sum(n).alias("_sum"), F.max(n).alias("_max"))
    out = df.crossJoin(F.broadcast(total))
    return out.withColumns({"pct": F.round(100.0 * F.col(n) / F.col("_sum"), digits), "vs_max": F.round(F.col(n) / F.col("_max"), 4)}).drop("_sum", "_max")
