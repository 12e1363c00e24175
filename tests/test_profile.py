"""The long profile table and what is read from it."""

from pyspark.sql import functions as F

from loomspark.operators import profile


def rows(spark):
    data = [("a", float(i), i % 2 == 0, "x" if i < 3 else None) for i in range(6)] + [(None, 10.0, None, "y"), ("b", None, True, "z"), ("b", float("nan"), True, "y"), ("a", 1000.0, False, "x")]
    return spark.createDataFrame(data, "g string, v double, f boolean, c string")


def test_profile_of_groups_and_whole(spark, tmp_path):
    out = profile.long_profile(rows(spark), "g", {"v": F.col("v"), "double": F.col("v") * 2}, {"f": F.col("f")}, {"c": F.col("c")}, top=2)
    got = {(r["grupo"], r["secao"], r["campo"], r["chave"]): r["valor"] for r in out.collect()}
    assert got["a", "numero", "v", "n"] == 7 and got["a", "numero", "v", "p50"] == 3.0 and got["a", "numero", "v", "outliers"] == 1 and got["a", "numero", "double", "max"] == 2000.0
    assert got["b", "numero", "v", "nulos"] == 2 and got["b", "numero", "v", "mean"] is None and got["b", "numero", "v", "p50"] is None
    assert got[None, "numero", "v", "n"] == 1 and got["(todos)", "numero", "v", "n"] == 8 and got["(todos)", "sinal", "f", "n"] == 10 and got["(todos)", "sinal", "f", "sim"] == 5 and got["a", "sinal", "f", "pct"] == 300 / 7
    assert got["(todos)", "categoria", "c", "x"] == 4 and got["(todos)", "categoria", "c", "y"] == 2 and ("(todos)", "categoria", "c", "z") not in got and got["(todos)", "dominante", "c", "x"] == 1
    side = {(r["campo"], r["chave"]): r["delta"] for r in profile.compared(out, "a", "(todos)").collect()}
    assert side["v", "p50"] == 3.0 - 3.5
    profile.write_profile(out, str(tmp_path / "p"))
    assert (tmp_path / "p" / "grupo=a").exists() and spark.read.parquet(str(tmp_path / "p")).count() == out.count()
    assert profile.long_profile(rows(spark).limit(0), "g", {"v": F.col("v")}).count() == 0
