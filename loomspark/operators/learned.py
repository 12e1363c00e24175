"""Learned models: k by silhouette, text clusters, feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt, parts_of, stored
from .bags import row_count, tfidf_of
from .stats import top_rows


def scaled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """``columns`` as one vector, each with mean 0 and population deviation 1 (0 where all values are equal)."""
    rows = df.na.drop(subset=list(columns))
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    rows = rows.crossJoin(F.broadcast(rows.agg(*aggs)))  # one row
    rows = rows.withColumns({f"_z_{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol=out).transform(rows).drop(*[f"_{p}_{c}" for c in columns for p in "msz"])


def kmeans_by_silhouette(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = tuple(range(2, 9)), seed: int = 42) -> DataFrame:
    """Rows with ``formato_<n>`` of the k whose silhouette (squared Euclidean) is best, and that k."""
    rows = scaled(df, columns).persist()
    judge = ClusteringEvaluator()
    best = None
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(rows)
        found = model.transform(rows)
        if found.select("prediction").distinct().count() < 2:
            continue
        score = judge.evaluate(found)
        if best is None or score > best[0]:
            best = (score, k, model)
    rows.unpersist()
    if best is None:
        return rows.drop("features").withColumns({"formato": F.lit("formato_1"), "k": F.lit(1)})
    out = best[2].transform(rows)
    return out.withColumns({"formato": F.concat(F.lit("formato_"), (F.col("prediction") + 1).cast("string")), "k": F.lit(best[1])}).drop("features", "prediction")


def text_clusters(df: DataFrame, text: str, tokens: Column, row: str, k: int | None = None, features: int = 200, starts: int = 3, seed: int = 42) -> DataFrame:
    """(cluster, n, termos, amostras, proximas): k-means over TF-IDF vectors of the ``features`` commonest terms (sublinear, unit length).

    ``termos`` are the six heaviest terms of a centre, ``amostras`` its first three texts by ``row``, ``proximas`` the three nearest to
    the centre (ties: the smaller row). k is min(5, max(2, n // 5)) by default; below 2 k rows there are no clusters. The
    best of ``starts`` runs counts. The vocabulary is all that comes to the driver. Rows without a term are zero vectors.
    Texts are taken apart once, in partitions of a size; the three of a cluster are found without its texts, which only they fetch.
    """
    spark = df.sparkSession
    result = f"cluster int, n long, termos array<string>, amostras array<{dict(df.dtypes)[text]}>, proximas array<{dict(df.dtypes)[text]}>"
    n = df.count()
    k = k or min(5, max(2, n // 5))
    terms = stored(dealt(df, row).select(row, tokens.alias("_terms")), "terms")  # read several times
    terms = terms.repartition(parts_of(df), row).select(row, F.explode("_terms").alias("term"))
    scores = tfidf_of(terms, row, row_count(df), sublinear=True, features=features).persist()
    try:
        vocabulary = sorted(r[0] for r in scores.select("term").distinct().collect())  # at most ``features``
        if n < 2 * k or not vocabulary:
            return spark.createDataFrame([], result)
        own = scores.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("term", "score"))).alias("_own"))
        weights = F.transform(F.array(*map(F.lit, vocabulary)), lambda t: F.coalesce(F.element_at("_own", t), F.lit(0.0)))
        rows = df.join(own, row, "left").select(F.col(row).alias("_row"), F.col(text).alias("_text"), F.coalesce(weights, F.array_repeat(F.lit(0.0), len(vocabulary))).alias("_v"))
        rows = rows.select("_row", "_text", array_to_vector("_v").alias("features")).persist()
        models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(rows) for i in range(starts)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(best.clusterCenters())], "cluster int, _c array<double>")  # k rows
        named = F.zip_with(F.array(*map(F.lit, vocabulary)), "_c", lambda t, w: F.struct((-w).alias("less"), t.alias("term")))
        heavy = F.transform(F.slice(F.array_sort(named), 1, 6), lambda s: s["term"])
        found = best.transform(rows).select(F.monotonically_increasing_id().alias("_at"), "_row", "_text", vector_to_array("features").alias("_v"), F.col("prediction").alias("cluster"))
        found = stored(found, "clusters")
        rows.unpersist()
    finally:
        scores.unpersist()
    far = F.aggregate(F.zip_with("_v", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    placed = found.join(F.broadcast(centres), "cluster").select("cluster", "_at", "_row", F.round(far, 12).alias("_far"))
    first, near = top_rows(placed, ["cluster"], [F.asc("_row")], 3, rank="_p"), top_rows(placed, ["cluster"], [F.asc("_far"), F.asc("_row")], 3, rank="_p")
    picked = first.select("cluster", "_at", "_p", F.lit("first").alias("_list")).unionByName(near.select("cluster", "_at", "_p", F.lit("near").alias("_list")))
    picked = found.select("_at", "_text").join(F.broadcast(picked), "_at")  # at most 6 k rows
    listed = lambda part, name: picked.where(F.col("_list") == part).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_text"))), lambda s: s["_text"]).alias(name))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"))
    out = sizes.join(F.broadcast(centres.select("cluster", heavy.alias("termos"))), "cluster").join(listed("first", "amostras"), "cluster").join(listed("near", "proximas"), "cluster")
    return out.select("cluster", "n", "termos", "amostras", "proximas")


def feature_importance(df: DataFrame, columns: Sequence[str], label: str, trees: int = 200, least_rows: int = 20) -> DataFrame | None:
    """(feature, importance), or None below two features, two classes or ``least_rows`` rows."""
    rows = df.select(*columns, label).na.drop()
    if len(columns) < 2 or rows.count() < least_rows or rows.select(label).distinct().count() < 2:
        return None
    indexed = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    ready = VectorAssembler(inputCols=list(columns), outputCol="features").transform(indexed)
    model = RandomForestClassifier(labelCol="_y", numTrees=trees, maxDepth=5, seed=42).fit(ready)
    pairs = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(pairs, "feature string, importance double")
