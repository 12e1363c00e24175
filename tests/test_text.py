"""Text features against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import positional as P
from loomspark.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    def of(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]

    return of


def test_transcripts(value):
    text = ">> Ana: [Music] look here (laughs) [Music] >> Bia: ♪ come back"
    assert value(T.is_dialogue, text) and not value(T.is_dialogue, ">> one") and value(T.is_dialogue, None) is False
    assert value(T.audio_cues, text) == ["[Music]", "(laughs)", "♪"]
    assert value(T.clean_transcript, text) == "look here come back"
    assert value(T.dominant_cue, text) == "[Music]" and value(T.dominant_cue, "none") is None


@pytest.mark.parametrize(("text", "want"), [("STOP doing THIS now A", 0.4), ("ok", 0.0), ("", 0.0), (None, 0.0)])
def test_capitals(value, text, want):
    assert value(T.caps_ratio, text) == want


@pytest.mark.parametrize(("text", "want"), [("The BEST secret ever!", 1.0), ("never again", 0.25), ("plain title", 0.0), (None, 0.0)])
def test_impact(value, text, want):
    assert value(T.impact_score, text) == want


@pytest.mark.parametrize(("n", "want"), [(0, 0), (20, 0.3636), (40, 1), (70, 1), (90, 0.3636), (120, 0)])
def test_length_score(spark, n, want):
    assert spark.range(1).select(F.round(T.length_score(F.lit(n)), 4).alias("v")).first()["v"] == want


@pytest.mark.parametrize(
    ("text", "label", "score"), [("Subscribe and like now", "direto", 0.7), ("Share and buy", "moderado", 0.4), ("Please follow me", "suave", 0.2), ("nothing here", "ausente", 0.0)]
)
def test_calls_to_action(value, text, label, score):
    out = value(T.cta, text)
    assert (out["intensidade"], out["score"]) == (label, score)


def test_keywords(value):
    out = value(lambda c: T.keyword_tails(T.comma_terms(c)), "shorts, comedy video, funny comedy shorts, viral")
    assert (out["shorttail"], out["midtail"], out["longtail"]) == (["shorts", "viral"], ["comedy video"], ["funny comedy shorts"])
    assert tuple(out["proporcao"]) == (0.5, 0.25, 0.25)
    assert value(T.list_literal, "['Funny', \"Cats\", dogs]") == ["funny", "cats", "dogs"]
    assert value(T.slug, "https://en.wikipedia.org/wiki/Caf%C3%A9_culture/") == "café culture"


def test_positions(spark, value):
    split = lambda c: F.split(c, " ")
    for n, (a, b) in {1: (0, 0), 4: (0, 3), 5: (1, 4), 7: (1, 5), 10: (2, 8)}.items():
        out = value(lambda c: P.thirds(split(c)), " ".join(map(str, range(n))))
        assert (len(out["inicio"]), len(out["meio"]), len(out["fim"])) == (a, b - a, n - b)
    assert value(lambda c: P.has_run(split(c)), "no no no way") and not value(lambda c: P.has_run(split(c)), "no no way no")
    rows = spark.createDataFrame([("cat dog cat bird",), ("cat",), ("",)], "t string")
    assert sorted((p["a"], p["b"]) for p in P.window_pairs(rows, split(F.col("t"))).collect()) == [("bird", "cat")] * 2 + [("bird", "dog")] + [("cat", "dog")] * 2
    assert value(lambda c: P.ngrams(split(c), 2), "a b c") == ["a b", "b c"] and value(lambda c: P.ngrams(split(c), 2), "a") == []
    assert sorted(r["term"] for r in P.ngram_rows(rows, split(F.col("t")), sizes=(2, 3)).collect()) == ["cat bird", "cat dog", "cat dog cat", "dog cat", "dog cat bird"]
    assert value(lambda c: P.max_repeat(split(c)), "b a b c b") == 3


def test_emoji(value):
    assert value(T.emojis, "hi 😂 there 👨‍👩‍👧 x") == ["😂", "👨‍👩‍👧"]
    assert [(e["emoji"], e["posicao"]) for e in value(T.emoji_positions, "😂 one two three four")] == [("😂", "inicio")]
    assert value(T.clean_title, "Go #now @you 😂 home") == "Go    home"


def test_scripts_and_rhythm(value):
    assert value(T.dominant_script, "привет мир") == "cyrillic" and value(T.dominant_script, "abc привет") == "mixed" and value(T.dominant_script, "12 !") == "ascii_only"
    out = value(T.sentence_rhythm, "one two three. one two three four five! x")
    assert (out["mean"], out["variance"]) == (4.0, 1.0)
    assert value(T.hook_flags, "Why did this fail?")["question"] and value(T.opening_formula, "Stop it") == "imperativo"
    assert value(lambda c: T.short_label(c, 5), "abcdefgh") == "abcde..." and value(T.title_case, "super_viral") == "Super Viral"
    assert value(T.unfenced, "```json\n{}\n```") == "{}"
