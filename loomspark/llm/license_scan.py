"""License scans by diagonal voting, with DataFrame functions only.

Every rolling word bigram of every text is hashed and joined to the bigrams of the license
templates. A match votes for the diagonal (word position in the text minus position in the
template). Votes are added up by diagonal, and each diagonal is merged with those at most ``MERGE``
after it, so that inserted or dropped words do not split a span. A span is verified if it lacks at
most the two bigrams that one dropped, replaced or two inserted words break, and holds the words in
which the notice differs from those of other licenses; a notice of five words may lack one bigram.
A base phrase stands wherever one diagonal holds all of its bigrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that the method looks for besides the base phrases, with their label and
#: their keys. Words of one key stand together, for what stands between them names another license.
NOTICES = {
    "licensed under the gnu general public license version 3": ("gpl-3.0", ("gnu general", "version 3")),
    "licensed under the gnu general public license version 2": ("gpl-2.0", ("gnu general", "version 2")),
    "gnu lesser general public license": ("lgpl", ("lesser",)),
    "gnu affero general public license": ("agpl", ("affero",)),
    "licensed under the apache license version 2 0": ("apache-2.0", ("apache", "version 2")),
    "licensed under cc by 4 0": ("cc-by-4.0", ("by 4",)),
    "licensed under cc by sa 4 0": ("cc-by-sa-4.0", ("by sa 4",)),
    "licensed under cc by nc 4 0": ("cc-by-nc-4.0", ("by nc 4",)),
    "released under the mit license": ("mit", ("mit",)),
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit", ()),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", ()),
    "subject to the terms of the mozilla public license v 2 0": ("mpl-2.0", ("mozilla", "v 2")),
    "this is free and unencumbered software released into the public domain": ("unlicense", ()),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", ()),
}
#: A span reaches over diagonals this far apart; bigrams that it may lack, and that one of a short notice may lack.
MERGE, LACKS, SHORT, SHORT_LACKS = 2, 2, 4, 1


def templates() -> list[tuple[int, str, bool, list[str]]]:
    """(template number, label, is a base phrase, words)."""
    both = [(p, n, True) for p, n in BASE.items()] + [(p, n, False) for p, (n, _) in NOTICES.items()]
    return [(i, label, base, phrase.split()) for i, (phrase, label, base) in enumerate(both)]


def verified() -> str:
    """SQL, of Spark and DuckDB alike: is the span (template, held) a notice? ``held`` are the numbers of its bigrams."""
    tests = []
    for t, (phrase, (_, keys)) in enumerate(NOTICES.items(), len(BASE)):
        words = phrase.split()
        size = len(words) - 1
        needs = [f"template = {t}", f"grams >= {size - (SHORT_LACKS if size <= SHORT else LACKS)}"]
        for key in (k.split() for k in keys):
            at = next(j for j in range(len(words)) if words[j : j + len(key)] == key)
            if len(key) == 1:
                needs.append("(" + " OR ".join(f"array_contains(held, {j})" for j in (at - 1, at) if 0 <= j < size) + ")")
            needs += [f"array_contains(held, {at + j})" for j in range(len(key) - 1)]
        tests.append(" AND ".join(needs))
    return "(" + " OR ".join(tests) + ")"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_bigrams(spark: SparkSession) -> DataFrame:
    """One row for each bigram of each template: a few hundred rows, fixed by the lists above."""
    rows = [(t, label, base, len(w) - 1, j, w[j], w[j + 1]) for t, label, base, w in templates() for j in range(len(w) - 1)]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, size int, at int, w1 string, w2 string")
    return frame.withColumn("gram", F.xxhash64("w1", "w2"))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, body, template, label, base, size, at, diagonal), distinct; body tells texts of one id apart."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), words_of(F.col("text")).alias("words"))
    pairs = words.select("doc_id", "body", F.posexplode(F.arrays_zip(F.col("words").alias("w1"), F.expr("slice(words, 2, size(words))").alias("w2"))).alias("pos", "pair"))
    grams = pairs.select("doc_id", "body", "pos", F.xxhash64("pair.w1", "pair.w2").alias("gram"), F.col("pair.w1").alias("a"), F.col("pair.w2").alias("b"))
    hits = grams.join(F.broadcast(template_bigrams(docs.sparkSession)), "gram").where("a = w1 and b = w2")
    return hits.select("doc_id", "body", "template", "label", "base", "size", "at", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base places, labels and the best span's share.

    A null text is empty: no words, no labels (empty strings), null first and last word, score 0.
    Repeated rows give equal results each, an empty table gives no rows, extra columns are ignored.
    """
    by_diagonal = votes(docs).groupBy("doc_id", "body", "template", "label", "base", "size", "diagonal").agg(F.collect_set("at").alias("found"))
    near = Window.partitionBy("doc_id", "body", "template").orderBy("diagonal").rangeBetween(0, MERGE)
    whole = F.col("base") & (F.size("found") == F.col("size"))
    spans = (
        by_diagonal.withColumn("held", F.array_distinct(F.flatten(F.collect_list("found").over(near))))
        .withColumn("grams", F.size("held"))
        .select("doc_id", "body", "label", "size", "grams", "diagonal", whole.alias("whole"), F.expr(verified()).alias("verified"))
    )
    found = spans.groupBy("doc_id", "body").agg(
        F.count_if("whole").alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("whole") | F.col("verified"), F.col("label")))), ",").alias("labels"),
        F.max(F.col("grams") / F.col("size")).alias("score"),
    )
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    same = [every.doc_id.eqNullSafe(found.doc_id), every.body == found.body]
    return every.join(found, same, "left").select(
        every.doc_id,
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same result in DuckDB SQL."""
    quote = lambda s: s.replace("'", "''")
    grams = ", ".join(f"({t}, '{quote(label)}', {str(base).lower()}, {len(w) - 1}, {j}, '{w[j]}', '{w[j + 1]}')" for t, label, base, w in templates() for j in range(len(w) - 1))
    return f"""
WITH grams(template, label, base, size, spot, w1, w2) AS (VALUES {grams}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
pairs AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM words)),
votes AS (SELECT DISTINCT doc_id, template, label, base, size, spot, pos - spot AS diagonal FROM pairs JOIN grams ON a = w1 AND b = w2),
diagonals AS (SELECT doc_id, template, label, base, size, diagonal, list(spot) AS found FROM votes GROUP BY ALL),
merged AS (SELECT *, list_distinct(flatten(list(found) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {MERGE} FOLLOWING))) AS held FROM diagonals),
spans AS (SELECT *, base AND len(found) = size AS whole, {verified()} AS verified FROM (SELECT *, len(held) AS grams FROM merged)),
found AS (SELECT doc_id, count(*) FILTER (whole) AS n_base, (min(diagonal) FILTER (whole))::BIGINT AS first_word, (max(diagonal) FILTER (whole))::BIGINT AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (whole)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label) FILTER (whole OR verified)), ',') AS labels,
  max(grams / size)::DOUBLE AS score FROM spans GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN found USING (doc_id)"""
