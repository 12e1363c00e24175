"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomspark.llm import simhash
from loomspark.llm.common import materialize
from tests.llm.test_operators import prose


def test_stages_keep_clean_documents_and_catch_planted_ones(spark, tmp_path):
    r = random.Random(1)
    items = [prose(500 + i, 40) for i in range(3)]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [prose(600 + i, 150) for i in range(40)]
    near = clean[3].split()
    near[70] = "altered"
    planted = ["12 34 !!", None, clean[0], clean[1] + "\n" + clean[2], " ".join(near), prose(700, 40) + " " + items[1]]
    rows = [(i, t, r.choice(["en", None]), "s", len(t or "")) for i, t in enumerate([*clean, *planted])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    gone = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, str(tmp_path)), name)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        before, after = ({x[0] for x in d.select("doc_id").collect()} for d in (docs, out))
        gone.append(before - after)
        docs = out
    assert gone == [{40, 41}, {42, 43}, {44}, {45}]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x[0] for x in packed.select("doc_id").collect()} == set(range(40))


def odd_rows():
    """Clean texts, a null id, a null and an empty text, a repeated row, a very long text, ties and junk."""
    long = " ".join(prose(900 + i, 200) for i in range(200))
    texts = [prose(600 + i, 60) for i in range(20)]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t)) for i, t in enumerate(texts)]
    rows += [(None, prose(700, 60), "en", "s", 1), (50, None, None, None, None), (51, "", "en", "s", 0), rows[7], (52, long, "en", "hot", len(long)), (53, texts[4], None, "s", 1), (54, texts[4], None, "s", 1), (55, "12 34 !!", None, "s", 8)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(0, prose(600, 60)), (1, None), (None, prose(601, 60)), (2, ""), (3, prose(602, 60)), (3, prose(602, 60))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = odd_rows()
    docs = materialize(spark.createDataFrame(rows, SCHEMA).withColumns({"length": F.lit("x"), "score": F.lit(1), "item_id": F.lit(2)}), "odd")  # names that operators use
    out = stage(spark, docs, folder).collect()
    if name == "best_fit_packing":
        starts = {(o["doc_id"], o["piece"], o["start"]) for o in out}
        assert {o["doc_id"] for o in out} == {r[0] for r in rows} and sum(o["piece"] == 0 for o in out) == len(rows) and max(o["piece"] for o in out if o["doc_id"] == 52) > 5 and (50, 0, 0) in starts
        return
    kept = sorted((tuple(o) for o in out), key=repr)
    assert all(len(o) == len(corpus_pipeline.COLUMNS) for o in kept)
    lost = set(rows) - set(kept)
    expected = {
        "language_id": {r for r in rows if r[0] in (50, 51, 55)}, "line_dedup": {r for r in rows if r[0] in (53, 54)}, "simhash_near_dedup": {r for r in rows if r[0] in (53, 54)},
        "decontamination": {r for r in rows if r[0] in (0, 2)},
    }[name]
    if name == "simhash_near_dedup":  # texts without words are one group
        lost -= {r for r in rows if r[0] in (50, 51, 55)}
    assert lost == expected
    if name != "line_dedup":
        assert sum(tuple(o) == rows[7] for o in out) == 2  # a repeated row shares its fate


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert out.count() == 0 and (name == "best_fit_packing" or tuple(out.columns) == corpus_pipeline.COLUMNS)
    if name == "decontamination":
        some = spark.createDataFrame(odd_rows()[:5], SCHEMA)
        assert stage(spark, some, str(tmp_path)).count() == 5


def test_near_duplicates_are_linked_by_fingerprints(spark, monkeypatch):
    """F8: the SimHash step gives links of its own, also where no other candidates are looked for."""
    texts = [prose(900, 300), prose(901, 300)]
    near = texts[0].split()
    near[-1] = "altered"
    docs = spark.createDataFrame([(0, texts[0]), (1, " ".join(near)), (2, texts[1])], "doc_id long, text string")
    everywhere = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(simhash, "candidate_pairs", lambda *args: spark.createDataFrame([], "a long, b long"))
    alone = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    assert everywhere == alone == {0: 0, 1: 0, 2: 2}
