"""Reports of all metrics by group, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import language, profile
from ..sources.readers import table
from .statistics_queries import WS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _profile(spark, d):
    t = F.col("text")
    words = F.size(T.ws_tokens(t))
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    numbers = {"palavras": words, "caracteres": F.col("n_chars"), "ritmo": F.round(words / 60.0, 2), "linhas": F.size(F.split(t, "\n")), "qualidade": F.col("quality")}
    flags = {"link": t.rlike("https?://"), "longo": words > 200, "toxico": F.coalesce(F.col("toxic") == 1, F.lit(False))}
    categories = {"origem": F.col("source"), "faixa": F.when(F.col("n_chars") < 500, "curto").when(F.col("n_chars") < 1800, "medio").otherwise("longo")}
    return profile.long_profile(joined, "lang", numbers, flags, categories, top=3)


_VALUES = {
    "n": "n", "nulos": "nulos", "mean": "m", "std": "s", "min": "lo", "max": "hi", "zeros": "z", "negatives": "neg", "skew": "sk", "kurtosis": "ku", "cv": "s / nullif(m, 0) * 100",
    "p10": "q[1]", "p25": "q[2]", "p50": "q[3]", "p75": "q[4]", "p90": "q[5]", "iqr": "q[4] - q[2]", "outliers": "o",
}


def _profile_sql(base: str, numbers: tuple[str, ...], flags: tuple[str, ...], categories: tuple[str, ...], top: int) -> str:
    """The SQL of ``long_profile`` over a query with a column ``grupo`` and one column a field."""
    long = " UNION ALL ".join(f"SELECT grupo, '{c}' AS campo, {c}::DOUBLE AS v FROM g" for c in numbers)
    stats = ", ".join(f"{{'chave': '{k}', 'v': ({v})::DOUBLE}}" for k, v in _VALUES.items())
    signs = " UNION ALL ".join(f"SELECT grupo, '{c}' AS campo, unnest([{{'chave': 'n', 'valor': count(*)::DOUBLE}}, {{'chave': 'sim', 'valor': (count(*) FILTER ({c}))::DOUBLE}}, {{'chave': 'pct', 'valor': 100.0 * count(*) FILTER ({c}) / count(*)}}], recursive := true) FROM g GROUP BY grupo" for c in flags)
    kinds = " UNION ALL ".join(f"SELECT grupo, '{c}' AS campo, {c} AS chave, count(*) AS n FROM g WHERE {c} IS NOT NULL GROUP BY ALL" for c in categories)
    return f"""WITH d AS ({base}), g AS MATERIALIZED (SELECT * FROM d UNION ALL SELECT * REPLACE ('(todos)' AS grupo) FROM d), l AS ({long}),
a AS (SELECT grupo, campo, count(v) AS n, count(*) - count(v) AS nulos, avg(v) AS m, stddev_samp(v) AS s, min(v) AS lo, max(v) AS hi, count(*) FILTER (v = 0) AS z, count(*) FILTER (v < 0) AS neg,
CASE WHEN stddev_pop(v) > 0 THEN skewness(v) END AS sk, CASE WHEN stddev_pop(v) > 0 THEN kurtosis(v) END AS ku, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM l GROUP BY ALL),
b AS (SELECT a.*, (SELECT count(*) FROM l WHERE l.grupo = a.grupo AND l.campo = a.campo AND NOT v BETWEEN q[2] - 1.5 * (q[4] - q[2]) AND q[4] + 1.5 * (q[4] - q[2])) AS o FROM a)
SELECT grupo, 'numero' AS secao, campo, u.chave, round(u.v::DOUBLE, 4) + 0.0 AS valor FROM b, LATERAL (SELECT unnest([{stats}], recursive := true)) AS u
UNION ALL SELECT grupo, 'sinal', campo, chave, round(valor, 4) FROM ({signs})
UNION ALL SELECT grupo, unnest(CASE WHEN r = 1 THEN ['categoria', 'dominante'] ELSE ['categoria'] END) AS secao, campo, chave, unnest(CASE WHEN r = 1 THEN [n::DOUBLE, 1.0::DOUBLE] ELSE [n::DOUBLE] END) AS valor
FROM (SELECT *, row_number() OVER (PARTITION BY grupo, campo ORDER BY n DESC, chave) AS r FROM ({kinds})) WHERE r <= {top}"""


_BASE = f"""SELECT lang AS grupo, len({WS}) AS palavras, n_chars AS caracteres, round(len({WS}) / 60.0, 2) AS ritmo, len(string_split(text, chr(10))) AS linhas, quality AS qualidade,
regexp_matches(text, 'https?://') AS link, len({WS}) > 200 AS longo, coalesce(toxic = 1, false) AS toxico, source AS origem, CASE WHEN n_chars < 500 THEN 'curto' WHEN n_chars < 1800 THEN 'medio' ELSE 'longo' END AS faixa FROM documents LEFT JOIN labels USING (doc_id)"""


@query(_profile_sql(_BASE, ("palavras", "caracteres", "ritmo", "linhas", "qualidade"), ("link", "longo", "toxico"), ("origem", "faixa"), 3))
def niche_profile(spark, d):
    return _profile(spark, d).withColumn("valor", F.round("valor", 4) + 0.0)


_GRAMS = " || ".join(f"list_transform(range(1, length(w) - {k - 2}), lambda i: substring(w, i::INT, {k}))" for k in language.SIZES)


@query(f"""WITH w AS (SELECT doc_id, lang, ' ' || unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) || ' ' AS w FROM documents), c AS (SELECT doc_id, lang, w, count(*) AS n FROM w GROUP BY ALL), g AS (SELECT doc_id, lang, n, unnest({_GRAMS}) AS gram FROM c),
d AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n) DESC, gram) AS rank FROM g WHERE gram <> ' ' GROUP BY doc_id, gram QUALIFY rank <= {language.RANKS}),
p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS rank FROM g WHERE gram <> ' ' AND lang IS NOT NULL GROUP BY lang, gram QUALIFY rank <= {language.RANKS}),
m AS (SELECT doc_id, lang, sum({language.RANKS} - abs(d.rank - p.rank)) AS near FROM d JOIN p USING (gram) GROUP BY ALL), b AS (SELECT doc_id, lang, near FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, lang) = 1)
SELECT x.doc_id, b.lang AS detected, coalesce(round(near / (k * {language.RANKS}.0), 4), 0)::DOUBLE AS score FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS k FROM d GROUP BY 1) s USING (doc_id)""")
def language_detect(spark, d):
    docs = table(spark, d, "documents")
    return language.detect(docs, "text", "doc_id", language.profiles(docs, "text", "lang"), "lang").withColumn("score", F.round("score", 4))


@query()
def stemmed_bigrams(spark, d):
    return language.stemmed_grams(table(spark, d, "documents"), T.content_tokens(F.col("text")), "doc_id", 20)


_COVER = f"""SELECT lang AS grupo, length(capa) AS capa_caracteres, len(list_filter(string_split_regex(capa, '\\s+'), lambda x: x <> '')) AS capa_palavras, length(cena) AS cena_caracteres, capa <> '' AS com_capa, cena <> '' AS com_cena, capa <> '' AND cena <> '' AS com_ambas,
regexp_matches(' ' || lower(cena) || ' ', '[^\\p{{L}}\\p{{M}}\\p{{N}}_]({"|".join(W.PERSON_WORDS)})s?[^\\p{{L}}\\p{{M}}\\p{{N}}_]') AS com_pessoa, CASE WHEN capa = '' THEN 'nenhuma' WHEN length(capa) < 30 THEN 'curta' ELSE 'longa' END AS tipo_capa
FROM (SELECT lang, array_to_string(list_slice({WS}, 1, 5), ' ') AS capa, array_to_string(list_slice({WS}, 6, 20), ' ') || CASE WHEN doc_id % 6 = 0 AND len({WS}) > 5 THEN ' with two girls' ELSE '' END AS cena FROM documents)"""


@query(_profile_sql(_COVER, ("capa_caracteres", "capa_palavras", "cena_caracteres"), ("com_capa", "com_cena", "com_ambas", "com_pessoa"), ("tipo_capa",), 3))
def thumbnail_profile(spark, d):
    """Cover texts and scenes by niche: lengths, coverage, people; the first words of a document stand for its cover."""
    toks = T.ws_tokens(F.col("text"))
    girls = F.when((F.col("doc_id") % 6 == 0) & (F.size(toks) > 5), " with two girls").otherwise("")
    rows = table(spark, d, "documents").select("lang", F.array_join(F.slice(toks, 1, 5), " ").alias("capa"), F.concat(F.array_join(F.slice(toks, 6, 15), " "), girls).alias("cena"))
    has = lambda c: F.col(c) != ""
    size = F.char_length("capa")
    numbers = {"capa_caracteres": size, "capa_palavras": F.size(T.ws_tokens(F.col("capa"))), "cena_caracteres": F.char_length("cena")}
    flags = {"com_capa": has("capa"), "com_cena": has("cena"), "com_ambas": has("capa") & has("cena"), "com_pessoa": T.has_person(F.col("cena"))}
    kinds = {"tipo_capa": F.when(size == 0, "nenhuma").when(size < 30, "curta").otherwise("longa")}
    return profile.long_profile(rows, "lang", numbers, flags, kinds, top=3).withColumn("valor", F.round("valor", 4) + 0.0)
