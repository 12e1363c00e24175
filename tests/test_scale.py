"""Steps whose work or memory must not grow faster than the input."""

import math
import random

from pyspark.sql import functions as F

from loomspark import session
from loomspark.functions import text as T
from loomspark.operators import bags, language, patterns, terms
from loomspark.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_language_of_rows_shuffles_texts_only(spark, tmp_path):
    """words and n-grams of a row stay in the task of the row."""
    docs = written(spark, f"{tmp_path}/d", [(i, f"the cat number {i} sat", "en") for i in range(20)], "id long, t string, lang string")
    shown = plan(language.detect(docs, "t", "id", language.profiles(docs, "t", "lang").localCheckpoint(), "lang"))
    assert "hashpartitioning(id" in shown and ", word" not in "".join(x for x in shown.splitlines() if "Exchange hashpartitioning" in x) and "hashpartitioning(gram" not in shown


def test_tfidf_queries_take_the_whole_vocabulary(spark, tmp_path):
    """A document of rare words only has terms, however many commoner ones there are."""
    common = " ".join(f"word{i}" for i in range(6000))
    rows = [(i, common, "en", "s", 1) for i in range(2)] + [(9, "zebra zeppelin", "en", "s", 1)]
    written(spark, f"{tmp_path}/documents.parquet", rows, "doc_id long, text string, lang string, source string, n_chars long")
    written(spark, f"{tmp_path}/labels.parquet", [(0, 1, 0), (1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    query = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r["term"] for r in query("tfidf_top_doc") if r["doc_id"] == 9) == ["zebra", "zeppelin"]
    assert [r["term"] for r in query("tfidf_corpus")][:2] == ["zebra", "zeppelin"]
    assert {"zebra", "zeppelin"} <= {r["term"] for r in query("tfidf_contrast_top") if r["diff"] < -0.7}
    for name in ("tfidf_top_doc", "tfidf_corpus", "tfidf_contrast", "tfidf_contrast_top"):
        assert "<=" not in catalogue.ORACLES[name].split("dfs AS")[1].split(")", 2)[1]


def test_tasks_do_not_grow_with_the_input(spark, tmp_path):
    """texts are dealt out in partitions of a size, and no key is split."""
    docs = written(spark, f"{tmp_path}/a b", [(i % 50, str(random.random())) for i in range(2000)], "id long, t string")
    size = session.file_bytes(docs)
    few, many = session.dealt(docs, "id", size=size), session.dealt(docs, "id", size=size // 40)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() >= 40
    assert many.select("id", F.spark_partition_id().alias("p")).distinct().count() == 50 and many.count() == 2000


def test_common_rows_are_those_of_a_plain_count(spark, monkeypatch):
    """rare rows are left out early and change nothing; null groups, ties and small groups included."""
    r = random.Random(3)
    rows = [(i, r.choice(["x", "y", None]), f"w{min(r.randrange(1, 400) for _ in range(4))}") for i in range(6000)] + [(7000, "small", "w1"), (7001, "small", "w2")]
    terms = spark.createDataFrame(rows, "id long, g string, term string")
    shown = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for cells in (8, 1 << 20):
        monkeypatch.setattr(bags, "CELLS", cells)
        for by, k in ((["g"], 7), ([], 11), (["g"], 1000)):
            assert shown(bags.top_counts_of_rows(terms, "id", by, k)) == shown(bags.top_counts(terms, by, k))
    assert bags.top_counts_of_rows(terms.where("false"), "id", ["g"], 3).count() == 0 and bags.top_counts_of_rows(terms.where("false"), "id", [], 3).count() == 0


def test_rows_meet_their_group_where_they_are(spark):
    """no shuffle of texts by group."""
    docs = spark.createDataFrame([(1, "en", "cat dog"), (2, None, "dog cat")], "id long, lang string, t string")
    pairs = bags.cooccurrence(docs, T.ws_tokens(F.col("t")), ["lang"])
    assert "SortMergeJoin" not in plan(pairs) and sorted(map(tuple, pairs.collect()), key=repr) == sorted([("en", "cat", "dog", 1), (None, "cat", "dog", 1)], key=repr)
    rows = patterns.features(spark.createDataFrame([(1, "en", "cat dog")], "id long, nicho string, texto string"))
    assert "SortMergeJoin" not in plan(patterns.pattern_bags(rows, patterns.pattern_scalars(rows, wanted=()), bags={"vocabulario": 5}))


def test_dominant_script_takes_the_text_apart_once(spark):
    """the scripts other than Latin are looked for in what is left without it."""
    texts = {"abc é": "latin", "слово abc": "mixed", "слово слово 12": "cyrillic", "λόγος": "greek", "12 !?": "ascii_only", "": "ascii_only", None: "ascii_only", "漢字かな": "mixed", "aaaa漢": "latin", "aaa漢": "mixed", "𠀀": "han"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.dominant_script(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in df.collect()} == texts
    assert plan(df).split("LocalTableScan")[0].count("regexp_count") <= 2 * (len(T.SCRIPTS) - 1)


def test_candidates_shuffle_common_terms_only(spark):
    """The terms of the rows meet the few of their group where they are, and the scores are those of a plain count."""
    r = random.Random(4)
    rows = [(i, r.choice(["x", "y", None]), [f"w{min(r.randrange(1, 60) for _ in range(3))}" for _ in range(r.randrange(0, 30))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, toks array<string>")
    found = terms.candidate_terms(df, F.col("toks"), "id", ["g"], 7, 5)
    assert "SortMergeJoin" not in plan(found).split("term#")[0] and "hashpartitioning(id" not in plan(found)
    for g in ("x", "y", None):
        docs = [t for _, h, t in rows if h == g]
        top = sorted({w for t in docs for w in t}, key=lambda w: (-sum(t.count(w) for t in docs), w))[:7]
        idf = {w: math.log((1 + len(docs)) / (1 + sum(w in t for t in docs))) + 1 for w in top}
        score = dict.fromkeys(top, 0.0)
        for t in docs:
            own = {w: t.count(w) * idf[w] for w in top if w in t}
            for w, x in own.items():
                score[w] += x / math.sqrt(sum(y * y for y in own.values())) / len(docs)
        best = sorted(((round(x, 6), w) for w, x in score.items()), key=lambda s: (-s[0], s[1]))[:5]
        assert [(q.score, q.term) for q in sorted(found.collect(), key=lambda q: q["rank"]) if q.g == g] == best


def test_bags_leave_rare_pairs_where_they_are(spark, monkeypatch):
    """pairs and bigrams are told from rare ones by cells; all bags are those of a plain count, niches without a word or with few ones included."""
    r = random.Random(5)
    word = lambda: f"{'abcdefgh'[min(r.randrange(8) for _ in range(2))]}{r.choice(['lor', 'mit', 'sun'])}"
    texts = [(i, r.choice(["x", "y", None]), " ".join(word() for _ in range(r.randrange(0, 40))) + r.choice(["", " love happy great", " hate awful bad"])) for i in range(120)]
    rows = patterns.features(spark.createDataFrame([*texts, (500, "empty", ""), (501, "few", "sun mit sun")], "id long, nicho string, texto string")).localCheckpoint()
    scalars = patterns.pattern_scalars(rows, wanted=()).localCheckpoint()
    sizes = {"vocabulario": 7, "moldes": 6, "pares": 9, "inicio": 5, "meio": 40, "fim": 5}
    found = patterns.pattern_bags(rows, scalars, bags=sizes)
    assert "_cell" in plan(found)
    tones, want = {q["nicho"]: q for q in scalars.collect()}, {}
    for q in rows.select("nicho", "_content", "tom").collect():
        w, n = q["_content"], len(q["_content"])
        at = lambda i: "inicio" if i < math.floor(n * 0.2) else "meio" if i < math.floor(n * 0.8) else "fim"  # noqa: B023, E731
        own = [("vocabulario", t, "", True) for t in w] + [("moldes", f"{a} {b}", "", True) for a, b in zip(w, w[1:], strict=False)]
        own += [("pares", min(w[i], w[j]), max(w[i], w[j]), True) for i in range(n) for j in range(i + 1, min(n, i + 6)) if w[i] != w[j]]
        own += [(at(i), t, "", q["tom"][at(i)] == tones[q["nicho"]][f"tom_{at(i)}"]) for i, t in enumerate(w)]
        for kind, a, b, keep in own:
            c = want.setdefault((q["nicho"], kind), {}).setdefault((a, b), [0, 0])
            c[0], c[1] = c[0] + keep, c[1] + 1
    got = {}
    for q in found.collect():
        got.setdefault((q["nicho"], q["kind"]), []).append((q["rank"], q["a"], q["b"], q["n"]))
    for (niche, kind), counts in want.items():
        few = kind in patterns.ARC and sum(c[0] > 0 for c in counts.values()) < sizes[kind]
        best = sorted((-(c[0] + c[1] * few), *k) for k, c in counts.items() if c[0] + c[1] * few)[: sizes[kind]]
        assert sorted(got.get((niche, kind), [])) == [(i + 1, a, b, -n) for i, (n, a, b) in enumerate(best)], (niche, kind)
    assert set(got) <= set(want)
    terms = rows.select("nicho", "id", F.explode("_content").alias("term"))
    plain = sorted(map(tuple, bags.top_counts(terms, ["nicho"], 4).collect()), key=repr)
    for cells in (2, 8, 1 << 20):  # fewer cells than groups, too
        monkeypatch.setattr(bags, "CELLS", cells)
        assert sorted(map(tuple, bags.top_counts_of_rows(terms, "id", ["nicho"], 4, hashes=2).collect()), key=repr) == plain
