"""Relational, statistical, service and source operators on small tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomspark.operators import bags, filters, patterns, service, stats, vectors
from loomspark.sources import readers


def test_adjusted_moments(spark):
    x = [1, 2, 2.5, 9, 40]
    out = stats.describe(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert np.allclose([out["skew"], out["kurtosis"], out["std"], out["q1"], out["q3"]], [2.048665, 4.237689, 16.569550, 2, 9])
    fences = stats.tukey(spark.createDataFrame([("a", float(v)) for v in x], "g string, x double"), "x", ["g"], 2).first()
    assert (fences["low"], fences["high"], fences["outliers"], fences["largest"]) == (-8.5, 19.5, 1, [40.0, 9.0])


def test_mode_takes_the_smallest_of_ties(spark):
    rows = spark.createDataFrame([(c,) for c in "baabc"] + [(None,)] * 5, "c string")
    assert rows.agg(stats.mode("c")).first()[0] == "a"


def test_tfidf_values(spark):
    docs = spark.createDataFrame([(0, ["a", "b", "b"]), (1, ["b", "c"])], "id int, t array<string>")
    got = {(r["id"], r["term"]): round(r["score"], 6) for r in bags.tfidf(docs, F.col("t"), "id").collect()}
    assert got == {(0, "a"): 0.574962, (0, "b"): 0.81818, (1, "b"): 0.579739, (1, "c"): 0.814802}


def test_rank_correlation_with_ties(spark):
    a, b = [1, 2, 2, 3, 5, 8], [2, 1, 4, 4, 7, 6]
    rows = spark.createDataFrame([*zip(a, b, strict=True), (None, 3)], "a int, b int")
    want = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert abs(stats.spearman(rows, "a", "b").first()["r"] - want) < 1e-12


def test_fallback_bags(spark):
    rows = spark.createDataFrame([("g", ["x", "y"], True), ("g", ["y", "z", "z"], False)], "g string, t array<string>, keep boolean")
    few = {r["term"]: r["n"] for r in bags.filtered_bag(rows, F.col("t"), F.col("keep"), ["g"], 3).collect()}
    enough = {r["term"]: r["n"] for r in bags.filtered_bag(rows, F.col("t"), F.col("keep"), ["g"], 2).collect()}
    assert few == {"y": 3, "x": 2, "z": 2} and enough == {"x": 1, "y": 1}


def test_band_keeps_groups_without_a_match(spark):
    rows = spark.createDataFrame([("a", "x" * 60), ("a", "x"), ("b", "y")], "g string, t string")
    assert sorted(r["t"] for r in filters.length_band(rows, "t", 50, 500, "g").collect()) == ["x" * 60, "y"]


def test_three_state_filter(spark):
    rows = spark.createDataFrame([(1, True), (2, False)], "id int, fav boolean")
    assert [filters.where_given(rows, fav=v).count() for v in (True, False, None)] == [1, 1, 2]


def test_feedback_by_niche(spark):
    rows = spark.createDataFrame([("A", "STRUCTURE", True), ("A", "SCRIPT", True), ("B", "STRUCTURE", False), ("C", "SCRIPT", True), ("C", "SCRIPT", False), ("C", "SCRIPT", True)], "n string, type string, is_useful boolean")
    out = {r["n"]: r for r in service.feedback_stats(rows, ["n"]).collect()}
    assert (out["A"]["structure_count"], out["A"]["script_percent"], out["B"]["structure_useful"], out["B"]["script_percent"], out["C"]["script_percent"]) == (1, 100, 0, 0, 67)


def test_upserts_and_links(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, age int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "id int, name string, age int")
    assert {tuple(r) for r in service.upsert(old, new, ["id"]).collect()} == {(1, "a", 5), (2, "b", 7), (3, "c", 8)}
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "user_id int, niche_id int")
    left = service.unlink_niches(links, spark.createDataFrame([(1, 1), (2, 1)], "user_id int, niche_id int"))
    assert {tuple(r) for r in left.collect()} == {(1, 2), (2, 1)}
    both, conflicts = service.link_niches(links, spark.createDataFrame([(1, 1), (3, 1)], "user_id int, niche_id int"))
    assert both.count() == 4 and [tuple(r) for r in conflicts.collect()] == [(1, 1)]
    users = spark.createDataFrame([(1, "a@x", None), (2, "b@x", None)], "id int, email string, deleted_at timestamp")
    gone = service.soft_delete(users, spark.createDataFrame([(2,)], "id int"), F.timestamp_millis(F.lit(1000)))
    assert {r["id"]: r["email"] for r in gone.collect()} == {1: "a@x", 2: "b@x+deleted_1000"} and filters.active(gone).count() == 1


def test_representatives_are_diverse(spark):
    rows = spark.createDataFrame([(0, "g", [1.0, 0.1]), (1, "g", [1.0, 0.0]), (2, "g", [0.0, 1.0]), (3, "g", [-1.0, 0.0])], "id int, g string, v array<double>")
    picks = [r["id"] for r in vectors.representatives(rows, "id", "v", ["g"]).orderBy("pick").collect()]
    assert picks == [0, 1, 3]  # nearest to the centroid, then the two of the rest that are least alike


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "silver.csv").write_text('video_id,nicho,titulo,tags\n' + 'v1,comedy,"line one\nline ""two""","[\'A\', \'b\']"\n' + "v2,tech, ,\n")
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "silver.csv"))
    rows = {r["video_id"]: r for r in readers.typed(raw).collect()}
    assert rows["v1"]["titulo"] == 'line one\nline "two"' and rows["v1"]["tags"] == ["a", "b"] and rows["v2"]["titulo"] is None
    docs = spark.createDataFrame([(i, "comedy" if i % 2 else "tech", f"Why is video {i} the best secret ever? Subscribe now and watch it again") for i in range(20)], "id int, nicho string, texto string")
    out = patterns.pattern_documents(docs)
    readers.write_patterns(out, str(tmp_path / "patterns"))
    doc = readers.read_pattern(spark, str(tmp_path / "patterns"), "Comedy").first()
    assert doc["n"] == 10 and doc["structure_content"]["titulo"]["formula_construcao"] == "pergunta" and doc["script_content"]["cta"]["estilo"] == "direto"


def test_rank_test_has_the_p_values_of_the_t_distribution(spark):
    assert np.allclose(stats.t_tail(np.array([2.0, 0.0, -3.5, 12.706205]), np.array([10, 5, 20, 1])), [0.07338803, 1.0, 0.00225, 0.05], atol=2e-5)
    rows = spark.createDataFrame([("g", float(i), float(i * i % 7)) for i in range(30)] + [("few", 1.0, 2.0)], "g string, a double, b double")
    out = stats.spearman_test(rows, "a", "b", ["g"]).collect()
    assert [r["g"] for r in out] == ["g"] and 0 < out[0]["p"] < 1 and not out[0]["significant"]


def test_farthest_pair_over_blocks(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((60, 4))
    rows = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)], "id int, g string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.unravel_index((u @ u.T).argmin(), (60, 60))
    best = vectors.farthest_pairs(rows, "id", "v", ["g"], block=7).first()
    assert (best["a"], best["b"]) == (min(i, j), max(i, j))


def test_validation_finds_what_is_missing(spark):
    docs = spark.createDataFrame([("a", '{"t": {"x": "1", "y": []}}'), ("b", "no json"), ("c", '{"t": {"x": "1", "y": ["z"]}}')], "nicho string, block string")
    out = {r["nicho"]: r["faltando"] for r in patterns.missing_fields(docs, {"t.x": "block", "t.y": "block"}).collect()}
    assert out == {"a": ["block.t.y"], "b": ["block.t.x", "block.t.y"], "c": []}
