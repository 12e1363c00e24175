"""Text vectors from a provider, and what pattern documents make of them."""

import numpy as np
from pyspark.sql import functions as F

from loomspark.operators import patterns
from loomspark.operators.embedding import HashedGrams, embedded


def counting(folder):
    """A loader whose model notes every load and every text that it is asked for."""

    def load():
        import os
        import uuid

        import numpy as np

        class Model:
            def __init__(self):
                open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

            def encode(self, texts):
                with open(f"{folder}/texts-{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(texts))
                return np.array([[len(t), t.count("a") + 1.0, t.count(" ") + 1.0] for t in texts])

        return Model()

    return load


def asked(folder):
    return [line for f in folder.glob("texts-*") for line in f.read_text().splitlines()]


def test_each_distinct_text_is_encoded_once(spark, tmp_path):
    (notes := tmp_path / "notes").mkdir()
    load, cache = counting(str(notes)), str(tmp_path / "cache")
    first = spark.createDataFrame([(f"text a{i % 7}",) for i in range(100)] + [(None,)], "t string").repartition(8)
    out = {r["t"]: r["vector"] for r in embedded(first, "t", load, "fake-1", cache).collect()}
    assert sorted(asked(notes)) == sorted(out) == [f"text a{i}" for i in range(7)] and out["text a3"] == [7.0, 2.0, 2.0]
    more = spark.createDataFrame([("text a3",), ("new",)], "t string")
    assert sorted(r["t"] for r in embedded(more, "t", load, "fake-1", cache).collect()) == ["new", "text a3"]
    assert sorted(asked(notes)) == sorted([*out, "new"])
    loads = [f.name.split("-")[1] for f in notes.glob("load-*")]
    assert len(loads) == len(set(loads))  # once a worker
    assert embedded(more.limit(0), "t", load, "fake-1", cache).count() == 0


def test_stand_in_is_deterministic():
    a, b = HashedGrams().encode(["Some words here", ""]), HashedGrams().encode(["some WORDS here", "x"])
    assert np.array_equal(a[0], b[0]) and np.isclose(np.linalg.norm(a[0]), 1) and not a[1].any() and a.shape == (2, 64)


def videos(spark):
    rows = []
    for i in range(24):
        niche = "cook" if i < 12 else None
        title = f"{'Boil pasta water slowly' if i % 2 else 'Fry crispy onion rings'} number {'one two three four five six'.split()[i % 6]}"
        rows.append((i, niche, f"{title}\nSubscribe to the channel and share it now. We boil pasta water and fry onion rings today. Like and comment below please.", title))
    return spark.createDataFrame(rows, "id int, nicho string, texto string, titulo string")


def test_document_has_meant_terms_and_diverse_examples(spark, tmp_path):
    (notes := tmp_path / "notes").mkdir()

    def load():
        """Bags of letters; a label of calls to action is near to every text that holds 'subscribe' or 'like'."""
        import uuid

        import numpy as np

        class Model:
            def encode(self, texts):
                with open(f"{notes}/texts-{uuid.uuid4().hex}", "w") as f:
                    f.write("\n".join(t.replace("\n", "|") for t in texts))
                out = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] + [0.0, 0.0] for t in texts], float)
                for row, t in zip(out, texts, strict=True):
                    row[26] = 30.0 * ("subscribe" in t.lower() or t.startswith("call to action"))
                    row[27] = 30.0 * ("narrative" in t)
                return out

        return Model()

    out = {r["nicho"]: r.asDict(True) for r in patterns.pattern_documents(videos(spark), load=load, cache=str(tmp_path / "cache")).collect()}
    texts = asked(notes)
    assert len(texts) == len(set(texts)) and len(texts) > 30
    assert set(out) == {"cook", None}
    for doc in out.values():
        title = doc["structure_content"]["titulo"]
        assert {"pasta", "onion"} <= set(title["termos_obrigatorios"]) <= set(title["termos_frequentes"]) and all(len(t) >= 4 for t in title["termos_obrigatorios"])
        assert 1 <= len(title["exemplos_reais"]) <= 3 and all(" number " in t for t in title["exemplos_reais"])
        assert any("boil pasta" in t for t in doc["structure_content"]["descricao"]["moldes_frase"])
        assert doc["script_content"]["gancho"]["termos_obrigatorios"] and 1 <= len(doc["script_content"]["gancho"]["exemplos_reais"]) <= 3
        assert "subscribe" in doc["script_content"]["cta"]["molde_termos"]


def test_examples_follow_the_clusters(spark):
    """The picks of the first cluster come first; without clusters the whole topic is one; short texts are no examples."""
    rows = [("n", "titulo", i, f"first group text {i}", [1.0 + 0.01 * i, 0.0]) for i in range(8)] + [("n", "titulo", 10 + i, f"second group text {i}", [0.0, 5.0 + 0.02 * i]) for i in range(6)]
    rows += [("n", "capa", 0, "only one here", [1.0, 0.0]), ("n", "capa", 1, "and another one", [0.0, 1.0]), ("n", "capa", 2, "short", [0.5, 0.5]), (None, "titulo", 0, "alone in its niche", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "nicho string, topic string, row int, text string, vector array<double>")
    found = {(r["nicho"], r["topic"]): r["exemplos"] for r in patterns.diverse_examples(df.drop("vector"), df.select("text", "vector")).collect()}
    assert len(found["n", "titulo"]) == 3 and len({t.split()[0] for t in found["n", "titulo"]}) == 1
    assert sorted(found["n", "capa"]) == ["and another one", "only one here"] and found[None, "titulo"] == ["alone in its niche"]
    assert patterns.diverse_examples(df.drop("vector").limit(0), df.select("text", "vector")).count() == 0


def test_meant_terms_of_empty_tables(spark):
    texts = spark.createDataFrame([], "nicho string, topic string, row int, text string, toks array<string>")
    assert patterns.meant_terms(texts, lambda t: embedded(t, "text")).count() == 0 and texts.select(F.col("topic")).count() == 0
