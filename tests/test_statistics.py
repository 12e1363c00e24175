"""Exact quantiles and rank correlations by sketches, null groups, and that nothing runs while a plan is made."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import bags, filters, stats, terms, vectors

SHARES = (0.9, 0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


@pytest.fixture
def sketched(monkeypatch):
    """Groups of 100 rows and more are sketched, so coarsely that brackets matter."""
    monkeypatch.setattr(stats, "HEAVY_ROWS", 100)
    monkeypatch.setattr(stats, "ACCURACY", 100)


def values(seed):
    r = np.random.default_rng(seed)
    return {"a": np.concatenate([r.integers(0, 5, 300), r.normal(0, 1000, 900), [7] * 400]), None: r.normal(5, 2, 700), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([4.0])}


def frame(spark, groups):
    return spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None), ("a", float("nan"))], "g string, x double")


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_by_brackets(spark, sketched, seed):
    groups = values(seed)
    got = {r["g"]: r["p"] for r in stats.percentiles(frame(spark, groups), "x", SHARES, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, SHARES))
    assert np.allclose(stats.percentiles(frame(spark, groups), "x", SHARES).first()["p"], np.quantile(np.concatenate([*groups.values()]), SHARES))


def test_brackets_keep_few_rows(spark, sketched):
    """Of 20,000 distinct values only those near the wanted ranks go on."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    out = stats.percentiles(df, "x", (0.5,))
    assert out.first()["p"] == [9999.5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0 and "BroadcastExchange" in plan


def test_percentiles_of_empty_tables(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert stats.percentiles(df, "x", (0.5,), ["g"]).count() == 0 and stats.describe(df, "x", ["g"]).count() == 0
    assert stats.describe(df, "x").first()["median"] is None


def test_null_groups_stay(spark, sketched):
    groups = values(9)
    df = frame(spark, groups)
    described = {r["g"]: r for r in stats.describe(df, "x", ["g"]).where("n > 0").collect()}
    assert set(described) >= set(groups) and np.isclose(described[None]["median"], np.median(groups[None])) and np.isclose(described[None]["q1"], np.quantile(groups[None], 0.25))
    for name, got in {
        "tukey": stats.tukey(df, "x", ["g"]), "box": stats.box_plot(df, "x", ["g"]), "above": filters.above_quantile(df, "x", 0.5, ["g"]), "dynamic": filters.dynamic_minimum(df, F.col("x"), "g", -1e9),
        "length": filters.length_band(df.withColumn("t", F.col("x").cast("string")), "t", 1, 100, "g"), "median": stats.median_of(df, {"m": F.col("x")}, ["g"]).where("m is not null"),
    }.items():
        assert {r["g"] for r in got.collect()} >= set(groups), name
    outliers = {r["g"]: r["outliers"] for r in stats.tukey(df, "x", ["g"]).collect()}
    q1, q3 = np.quantile(groups[None], [0.25, 0.75])
    assert outliers[None] == ((groups[None] < q1 - 1.5 * (q3 - q1)) | (groups[None] > q3 + 1.5 * (q3 - q1))).sum()


def test_null_groups_of_terms_and_vectors(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "g", f"alpha beta word{i} gamma") for i in range(12)], "id int, g string, t string")
    toks = T.content_tokens(F.col("t"))
    for got in (bags.filtered_bag(docs, toks, F.col("id") > 4, ["g"], 3), bags.cooccurrence(docs, toks, ["g"]), bags.top_terms(docs, toks, ["g"], 2), terms.candidate_terms(docs, toks, "id", ["g"])):
        assert {r["g"] for r in got.collect()} == {None, "g"}
    e = spark.createDataFrame([(i, None if i % 2 else "g", [float(i), 1.0, float(i * i % 5)]) for i in range(10)], "id int, g string, v array<double>")
    assert {r["g"] for r in vectors.representatives(e, "id", "v", ["g"]).collect()} == {None, "g"}
    near = terms.semantic_filter(e, vectors.centroids(e, "v", ["g"]), ["g"], "id", "v")
    assert {r["g"] for r in near.collect()} == {None, "g"}


def ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("least", [50, 10**6])
def test_rank_correlations_of_pairs(spark, monkeypatch, least):
    """Each pair over the rows that have both, with ties, repeated rows, nulls and a null group."""
    monkeypatch.setattr(stats, "HEAVY_ROWS", least)
    r = np.random.default_rng(3)
    x = np.stack([r.integers(0, 6, 300), r.normal(0, 1, 300).round(1), r.integers(0, 300, 300)], 1).astype(float)
    x[:, 2] += 40 * x[:, 0]
    x[r.random((300, 3)) < 0.15] = np.nan
    cells = [(None if i % 3 else "g", *(None if np.isnan(c) else float(c) for c in v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(cells + cells[:60], "g string, a double, b double, c double")
    x = np.concatenate([x, x[:60]])
    inside = np.array([c[0] is None for c in cells + cells[:60]])
    got = {(o["g"], o["a"], o["b"]): (o["n"], o["r"]) for o in stats.rank_correlations(df, ["a", "b", "c"], ["g"]).collect()}
    assert len(got) == 6
    for g, rows in ((None, x[inside]), ("g", x[~inside])):
        for i, j in ((0, 1), (0, 2), (1, 2)):
            both = rows[~np.isnan(rows[:, i]) & ~np.isnan(rows[:, j])]
            n, value = got[g, "abc"[i], "abc"[j]]
            assert n == len(both) and np.isclose(value, np.corrcoef(ranks(both[:, i]), ranks(both[:, j]))[0, 1])


def test_nothing_runs_while_a_plan_is_made(spark):
    df = spark.range(50).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").alias("id"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit("some words here again").alias("t"), F.array(F.rand(3), F.rand(4)).alias("v"))
    spark.sparkContext.setJobGroup("definitions", "no job")
    toks = T.content_tokens(F.col("t"))
    try:
        _ = [
            stats.describe(df, "x", ["g"]), stats.tukey(df, "x", ["g"]), stats.box_plot(df, "x", ["g"]), stats.percentiles(df, "x", (0.5,)), stats.spearman_matrix(df, ["x", "y", "id"]), stats.spearman_test(df, "x", "y", ["g"]),
            filters.above_quantile(df, "x", 0.9, ["g"]), bags.filtered_bag(df, toks, F.col("x") > 0.5, ["g"], 5), bags.cooccurrence(df, toks, ["g"]), bags.tfidf(df, toks, "id", features=10), bags.ngram_tfidf(df, toks, "id", (2, 3), 10, 5),
            bags.contrast(df, toks, "id", F.col("x") > 0.5, 3), terms.candidate_terms(df, toks, "id", ["g"]), vectors.representatives(df, "id", "v", ["g"]), vectors.nearest_of(df, "v", df.select("id", "v").limit(3), "id", "v"),
        ]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("definitions")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_packed_sides_are_bounded(spark):
    rows = spark.range(20).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    assert vectors.with_each(rows.limit(2), rows.toDF("k", "w"), ("k", "w"), 20).count() == 40
    with pytest.raises(Exception, match="use an index"):
        vectors.with_each(rows, rows.toDF("k", "w"), ("k", "w"), 19).collect()


@pytest.mark.parametrize("common", [3, 10_000])
def test_rank_correlations_keep_rows_apart_and_frequent_values_out_of_the_shuffle(spark, monkeypatch, common):
    """rows that differ by where their nulls are stay two; the commonest values find their ranks where they are, and the result is the same."""
    monkeypatch.setattr(stats, "COMMON_VALUES", common)
    rows = [(1.0, None), (None, 1.0), (-0.0, 2.0), (0.0, 2.0), (3.0, 1.0), (3.0, 5.0), (7.0, 0.0), (7.0, float("nan"))] * 3
    df = spark.createDataFrame(rows, "a double, b double")
    out = stats.rank_correlations(df, ["a", "b"])
    both = np.array([r for r in rows if None not in r and r[1] == r[1]])
    found = out.first()
    assert found["n"] == len(both) and np.isclose(found["r"], np.corrcoef(ranks(both[:, 0]), ranks(both[:, 1]))[0, 1])
    shown = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [" in shown and shown.count("TakeOrderedAndProject(limit=%d" % common) >= 2


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_ranks_do_not_depend_on_ranges(spark, monkeypatch, parts):
    """the ranges are found in two steps, for any number of them."""
    monkeypatch.setattr(stats, "HEAVY_ROWS", 10)
    x = np.random.default_rng(5).integers(0, 90, 400).astype(float)
    df = spark.createDataFrame([(1, float(v)) for v in x], "g int, _x double")
    got = {r["_x"]: (r["_n"], r["centred"]) for r in stats.ranked_values(df, ["g"], [F.lit(1)], parts).collect()}
    assert got == {v: ((x == v).sum(), [r - 200.5]) for v, r in zip(x, ranks(x), strict=True)}
