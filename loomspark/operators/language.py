"""Language by n-gram ranks, and stems of English words by suffix rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import dealt
from .stats import top_rows

#: Ranks kept of a profile, sizes of the n-grams.
RANKS, SIZES = 300, (1, 2, 3)


def gram_counts(df: DataFrame, text: str, by: list[str], sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(by, gram, n): n-grams of the words of a text, each word between two blanks, in lower case.

    Words are counted before they are taken apart, so a common word costs one row.
    """
    words = df.select(*by, F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\p{L}\p{M}]+"), F.lit(0))).alias("word"))
    words = words.groupBy(*by, "word").agg(F.count("*").alias("n")).withColumn("word", F.concat(F.lit(" "), "word", F.lit(" ")))
    size = F.char_length("word")
    starts = lambda k: F.when(size >= k, F.sequence(F.lit(1), size - k + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.concat(*[_pieces(starts(k), k) for k in sizes])
    return words.select(*by, "n", F.explode(grams).alias("gram")).where("gram <> ' '").groupBy(*by, "gram").agg(F.sum("n").alias("n"))


def _pieces(starts: Column, k: int) -> Column:
    return F.transform(starts, lambda i: F.substring(F.col("word"), i, F.lit(k)))


def profiles(df: DataFrame, text: str, language: str, ranks: int = RANKS) -> DataFrame:
    """(language, gram, rank): the commonest n-grams of each language that has a name, ties in the order of the n-gram."""
    counts = gram_counts(df.where(F.col(language).isNotNull()), text, [language])
    return top_rows(counts, [language], [F.desc("n"), F.asc("gram")], ranks, rank="rank").drop("n")


def detect(df: DataFrame, text: str, row: str, known: DataFrame, language: str, ranks: int = RANKS) -> DataFrame:
    """(row, detected, score): the language whose profile is least out of place with that of the text; a text without letters has none.

    The distance of two profiles is the sum of the differences of their ranks, ``ranks`` for an n-gram that a language lacks. ``score``
    is what is left of the largest distance, from 0 to 1. Ties go to the smaller name. Profiles are ``ranks`` rows for each language
    and go to every task. The texts are dealt out by row once; words, n-grams and ranks of a row stay in its task.
    """
    own = top_rows(gram_counts(dealt(df.select(row, text), row), text, [row]), [row], [F.desc("n"), F.asc("gram")], ranks, rank="rank")
    own = own.withColumn("_grams", F.max("rank").over(Window.partitionBy(row)))
    met = own.select(row, "gram", "_grams", F.col("rank").alias("_own")).join(F.broadcast(known.select(language, "gram", F.col("rank").alias("_rank"))), "gram")
    near = met.groupBy(row, language).agg(F.first("_grams").alias("_grams"), F.sum(F.lit(ranks) - F.abs(F.col("_own") - F.col("_rank"))).alias("_near"))
    best = near.groupBy(row).agg(F.first("_grams").alias("_grams"), F.min(F.struct((-F.col("_near")).alias("_less"), language)).alias("_best"))
    found = best.select(row, F.col(f"_best.{language}").alias("detected"), (-F.col("_best._less") / (F.col("_grams") * ranks)).alias("score"))
    return df.select(row).distinct().join(found, row, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def held_out_share(df: DataFrame, text: str, row: str, language: str, held: Column) -> DataFrame:
    """(language, n, right): of the rows where ``held``, how many are told by profiles of the others."""
    known = profiles(df.where(~held), text, language)
    rows = df.where(held & F.col(language).isNotNull())
    found = detect(rows, text, row, known, language)
    return rows.select(row, language).join(found, row).groupBy(language).agg(F.count("*").alias("n"), F.count_if(F.col("detected") == F.col(language)).alias("right"))


# Stems

_c, _v = "[^aeiou]", "[aeiouy]"
_C, _V = f"{_c}[^aeiouy]*", f"{_v}[aeiou]*"
#: Forms of a stem by its vowel-consonant sequences: some, one, more than one; a vowel; consonant, vowel, consonant at the end.
SOME, ONE, MORE, VOWEL, SHORT = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}", f"^(?:{_C})?{_v}", f"^{_C}{_v}[^aeiouwxy]$"
#: The published suffixes of the second, third and fourth step, longer ones before those that end them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stemmed(df: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """``df`` with the stem of an English word in lower case: suffixes are stripped in five steps, where what is left is long enough.

    Words of one or two letters, and words with other letters than a to z, stay. Each step is a column of its own, so that Spark works it out once.
    """
    w = F.col(name)
    cut = lambda suffix: F.expr(f"left(`{name}`, char_length(`{name}`) - {len(suffix)})")

    def longest(rules: dict[str, str], form: str) -> Column:
        """The longest suffix that fits decides, also where its stem is too short."""
        out = w
        for suffix in sorted(rules, key=lambda s: (len(s), s)):
            out = F.when(w.endswith(suffix), F.when(cut(suffix).rlike(form), F.concat(cut(suffix), F.lit(rules[suffix]))).otherwise(w)).otherwise(out)
        return out

    fit = F.col(word).rlike("^[a-z]{3,}$")
    out = df.withColumn(name, F.when(fit & F.col(word).startswith("y"), F.concat(F.lit("Y"), F.expr(f"substring(`{word}`, 2)"))).otherwise(F.col(word)))
    steps = [
        F.when(w.rlike("(?:ss|i)es$"), cut("es")).when(w.rlike("[^s]s$"), cut("s")).otherwise(w),
        F.when(w.endswith("eed"), F.when(cut("eed").rlike(SOME), cut("d")).otherwise(w)).when(w.endswith("ed") & cut("ed").rlike(VOWEL), F.concat(cut("ed"), F.lit("#"))).when(w.endswith("ing") & cut("ing").rlike(VOWEL), F.concat(cut("ing"), F.lit("#"))).otherwise(w),
        F.when(~w.endswith("#"), w).when(w.rlike("(?:at|bl|iz)#$"), F.concat(cut("#"), F.lit("e"))).when(w.rlike(r"([^aeiouylsz])\1#$"), cut("x#")).when(cut("#").rlike(ONE) & cut("#").rlike(SHORT), F.concat(cut("#"), F.lit("e"))).otherwise(cut("#")),
        F.when(w.endswith("y") & cut("y").rlike(VOWEL), F.concat(cut("y"), F.lit("i"))).otherwise(w),
        longest(SECOND, SOME), longest(THIRD, SOME),
        reduce(lambda out, s: F.when(w.endswith(s), F.when(cut(s).rlike(MORE), cut(s)).otherwise(w)).otherwise(out), sorted(FOURTH, key=lambda s: (len(s), s)), F.when(w.rlike("[st]ion$"), F.when(cut("ion").rlike(MORE), cut("ion")).otherwise(w)).otherwise(w)),
        F.when(w.endswith("e"), F.when(cut("e").rlike(MORE) | (cut("e").rlike(ONE) & ~cut("e").rlike(SHORT)), cut("e")).otherwise(w)).otherwise(w),
        F.when(w.endswith("ll") & w.rlike(MORE), cut("l")).otherwise(w),
    ]
    for step in steps:
        out = out.withColumn(name, F.when(F.col(word).rlike("^[a-z]{3,}$"), step).otherwise(w))
    return out.withColumn(name, F.regexp_replace(w, "^Y", "y"))


def stemmed_grams(df: DataFrame, toks: Column, row: str, k: int, n: int = 2) -> DataFrame:
    """(gram, n): the ``k`` commonest n-grams of stems. Each word of the vocabulary is stemmed once; the stems come back to their places."""
    places = df.select(row, F.posexplode(toks).alias("_at", "_word"))
    stems = stemmed(places.select("_word").distinct(), "_word", "_stem")
    back = places.join(stems, "_word").groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_stem"))), lambda s: s["_stem"]).alias("_stems"))
    starts = F.when(F.size("_stems") >= n, F.sequence(F.lit(1), F.size("_stems") - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = back.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("_stems", i, n), " "))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(k)
