"""Text clusters against a small corpus worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import learned

THEMES = ("boil pasta water salt kitchen", "engine wheel brake road driver", "violin piano drum choir stage")


def corpus():
    texts = []
    for i in range(30):
        w = THEMES[i % 3].split()
        texts.append(" ".join([w[0], w[1], *[w[(i // 3 + j) % 5] for j in range(3)]]))
    return texts


def unit_vectors(texts, vocabulary):
    tf = np.array([[t.split().count(w) for w in vocabulary] for t in texts], float)
    tf[tf > 0] = 1 + np.log(tf[tf > 0])
    x = tf * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_text_clusters_of_three_themes(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = learned.text_clusters(df, "t", T.content_tokens(F.col("t")), "id", k=3).collect()
    assert sorted(o["n"] for o in out) == [10, 10, 10]
    vocabulary = sorted({w for t in texts for w in t.split()})
    x = unit_vectors(texts, vocabulary)
    for o in out:
        theme = next(i for i, t in enumerate(THEMES) if o["termos"][0] in t.split())
        own = range(theme, 30, 3)
        centre = x[list(own)].mean(0)
        weights = [centre[vocabulary.index(t)] for t in o["termos"]]
        assert set(o["termos"][:5]) == set(THEMES[theme].split()) and all(a > b - 1e-9 for a, b in zip(weights, weights[1:], strict=False))
        assert o["amostras"] == [texts[i] for i in list(own)[:3]]
        near = sorted(own, key=lambda i: (round(((x[i] - centre) ** 2).sum(), 12), i))[:3]
        assert o["proximas"] == [texts[i] for i in near]


def test_text_clusters_of_few_rows(spark):
    df = spark.createDataFrame([(1, "one text"), (2, None), (3, "")], "id int, t string")
    assert learned.text_clusters(df, "t", T.content_tokens(F.col("t")), "id").count() == 0
    assert learned.text_clusters(df.limit(0), "t", T.content_tokens(F.col("t")), "id").count() == 0


def test_text_clusters_sort_no_texts(spark):
    """the samples and the nearest rows of a cluster are found by number; a repeated row id names two texts."""
    texts = corpus()
    df = spark.createDataFrame([(min(i, 28), t) for i, t in enumerate(texts)], "id int, t string")
    out = learned.text_clusters(df, "t", T.content_tokens(F.col("t")), "id", k=3)
    sorts = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x or "Sort" in x]
    executed = out._jdf.queryExecution().sparkPlan().toString().split("WindowGroupLimit")[1:]
    assert sorts and executed and not any("_text" in part.split("Join")[0] for part in executed)
    for o in out.collect():
        assert len(o["amostras"]) == len(o["proximas"]) == 3 and set(o["amostras"] + o["proximas"]) <= set(texts)
