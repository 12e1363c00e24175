"""Stems against published examples, language by held-out accuracy."""

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import language

#: Examples that were published with the suffix rules, after all steps.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend",
    "adoption": "adopt", "communism": "commun", "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "yellowing": "yellow", "by": "by", "naïve": "naïve", "générations": "générations",
}


def test_stems_equal_published_examples(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    got = {r["w"]: r["stem"] for r in language.stemmed(df, "w").collect()}
    assert {w: (got[w], s) for w, s in STEMS.items() if got[w] != s} == {}


def test_stemmed_grams(spark):
    df = spark.createDataFrame([(1, "running dogs run dog"), (2, "runs dogs"), (3, None)], "id int, t string")
    out = [tuple(r) for r in language.stemmed_grams(df, T.tokens(F.col("t")), "id", 2).collect()]
    assert out == [("run dog", 3), ("dog run", 1)]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.where(F.char_length("text") > 100)
    out = language.held_out_share(rows, "text", "doc_id", "lang", F.col("doc_id") % 4 == 1).collect()
    assert sum(r["n"] for r in out) > 150 and sum(r["right"] for r in out) / sum(r["n"] for r in out) > 0.95


def test_language_of_odd_texts(spark):
    known = language.profiles(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("nobody", None)], "t string, l string"), "t", "l")
    rows = spark.createDataFrame([(1, "the dog"), (2, "12 34"), (3, None), (4, "die katze"), (1, "the dog")], "id int, t string")
    got = {r["id"]: (r["detected"], r["score"] > 0) for r in language.detect(rows, "t", "id", known, "l").collect()}
    assert got == {1: ("en", True), 2: (None, False), 3: (None, False), 4: ("de", True)}
