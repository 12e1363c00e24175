"""Learned models, pattern documents and composite reports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import density, learned, patterns, stats
from ..session import spread, stored
from ..sources.readers import table
from .statistics_queries import CONTENT, STOP, TOKENS, WORD, WS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_WINDOWS = ("madrugada", "manha", "tarde", "noite")


def videos(spark, d):
    """Documents as videos: what the tables lack (slots, rates, formats, cover texts) is worked out from doc_id, n_chars and the text."""
    t = F.col("text")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))
    toks = T.ws_tokens(t)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("nicho"), t.alias("texto"), T.first_line(t).alias("titulo"), F.slice(T.tokens(t), 1, 12).alias("palavras_chave"),
        F.array_join(F.slice(toks, 1, 5), " ").alias("texto_capa"), F.array_join(F.slice(toks, 6, 15), " ").alias("cena"), pick(_DAYS, F.floor(F.col("doc_id") / 3)).alias("dia"), pick(_WINDOWS, F.col("doc_id") * 5 + F.col("n_chars")).alias("janela"),
        F.lit(60.0).alias("duracao"), F.when(F.col("n_chars") < 500, "ultra_curto").otherwise("short_longo").alias("faixa"), (F.col("n_chars") % 700 / 100.0).alias("taxa_conversao"), (F.col("n_chars") % 1100 / 100.0).alias("taxa_discussao"),
        F.concat(F.lit("formato_"), (F.col("n_chars") % 3 + 1).cast("string")).alias("formato"),
    )


def _features(spark, d, *columns):
    """The stored features of the videos that a query reads, as several aggregates read them. No other is worked out: aggregates that name others see nulls."""
    rows = patterns.features(spread(videos(spark, d)))
    kept = stored(rows.select("nicho", *columns), "features")
    return kept.withColumns({f.name: F.lit(None).cast(f.dataType) for f in rows.schema if f.name not in kept.columns})


@query()
def pattern_document(spark, d):
    return patterns.pattern_documents(videos(spark, d))


@query(f"""WITH f AS (SELECT lang AS nicho, len({WS})::BIGINT AS w, length(trim(string_split(trim(text), chr(10))[1])) AS t, regexp_matches(text, 'https?://\\S+') AS l, n_chars % 700 / 100.0 AS c FROM documents)
SELECT nicho, count(*)::BIGINT AS n, round(median(w), 3) AS palavras, round(median(t), 3) AS titulo_comprimento, round(avg(l::INT), 4) AS taxa_link, round(median(c), 3) AS conversao FROM f GROUP BY 1""")
def pattern_scalars(spark, d):
    out = patterns.pattern_scalars(patterns.features(videos(spark, d)), wanted=("palavras", "titulo_comprimento", "conversao"))
    return out.select("nicho", "n", *[F.round(c, 3).alias(c) for c in ("palavras", "titulo_comprimento")], F.round("taxa_link", 4).alias("taxa_link"), F.round("conversao", 3).alias("conversao"))


_VIDEO = f"""v AS (SELECT doc_id AS id, lang AS nicho, text AS texto, trim(string_split(trim(text), chr(10))[1]) AS titulo, list_slice({TOKENS}, 1, 12) AS palavras_chave, {WS} AS toks, {CONTENT} AS content,
  (['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday'])[(doc_id // 3) % 7 + 1] AS dia, (['madrugada', 'manha', 'tarde', 'noite'])[(doc_id * 5 + n_chars) % 4 + 1] AS janela,
  n_chars % 700 / 100.0 AS taxa_conversao, n_chars % 1100 / 100.0 AS taxa_discussao, 'formato_' || (n_chars % 3 + 1) AS formato, CASE WHEN n_chars < 500 THEN 'ultra_curto' ELSE 'short_longo' END AS faixa FROM documents)"""


def _bags(spark, d, *kinds):
    rows = _features(spark, d, *[f"_bag_{k}" if k in ("shorttail", "slots") else "_content" for k in kinds])
    out = patterns.pattern_bags(rows, patterns.pattern_scalars(rows, wanted=()), bags={k: patterns.BAGS[k] for k in kinds})
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_VIDEO}, t AS (SELECT nicho, unnest(palavras_chave) AS term FROM v), c AS (SELECT nicho, term, count(*)::BIGINT AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY nicho ORDER BY n DESC, term)::BIGINT AS rank FROM c)
SELECT nicho, term, n, rank FROM r WHERE rank <= 15""")
def pattern_keywords(spark, d):
    return _bags(spark, d, "shorttail").select("nicho", F.col("a").alias("term"), "n", "rank")


@query(f"""WITH {_VIDEO}, c AS (SELECT nicho, dia, janela, count(*)::BIGINT AS n FROM v GROUP BY ALL) SELECT nicho, dia, janela, n, row_number() OVER (PARTITION BY nicho ORDER BY n DESC, dia, janela)::BIGINT AS rank FROM c QUALIFY rank <= 3""")
def pattern_posting(spark, d):
    return _bags(spark, d, "slots").select("nicho", F.col("a").alias("dia"), F.col("b").alias("janela"), "n", "rank")


@query(f"""WITH {_VIDEO}, t AS (SELECT nicho, unnest(content) AS term FROM v), c AS (SELECT nicho, term, count(*)::BIGINT AS n FROM t GROUP BY 1, 2) SELECT nicho, term, n, row_number() OVER (PARTITION BY nicho ORDER BY n DESC, term)::BIGINT AS rank FROM c QUALIFY rank <= 30""")
def pattern_vocabulary(spark, d):
    return _bags(spark, d, "vocabulario").select("nicho", F.col("a").alias("term"), "n", "rank")


@query(f"""WITH {_VIDEO}, m AS (SELECT nicho, round(median(taxa_conversao), 3) AS conversao, median(taxa_discussao) AS disc, quantile_cont(taxa_discussao, 0.75) AS alta FROM v GROUP BY 1)
SELECT nicho, CASE WHEN conversao >= 5 THEN 'direto' WHEN conversao >= 2 THEN 'moderado' ELSE 'suave' END AS intensidade, disc >= alta AS debate, round(disc, 3) AS discussao FROM m""")
def pattern_cta(spark, d):
    s = patterns.pattern_scalars(patterns.features(videos(spark, d)), wanted=("conversao", "discussao", "discussao_alta"))
    return s.select("nicho", patterns.conversion_intensity(F.round("conversao", 3)).alias("intensidade"), (F.col("discussao") >= F.col("discussao_alta")).alias("debate"), F.round("discussao", 3).alias("discussao"))


@query(f"""WITH {_VIDEO}, c AS (SELECT nicho, formato, count(*) AS k FROM v GROUP BY 1, 2), dom AS (SELECT nicho, formato FROM c QUALIFY row_number() OVER (PARTITION BY nicho ORDER BY k DESC, formato) = 1),
w AS (SELECT v.nicho, len(toks) AS w, len(toks) / 60.0 AS p, coalesce(list_max(list_transform(list_distinct(x), lambda t: len(list_filter(x, lambda y: y = t)))), 0) >= 5 AS rep, faixa FROM (SELECT *, list_filter(regexp_extract_all(lower(texto), '{WORD}+'), lambda t: regexp_full_match(t, '[a-z]{{3,}}') AND NOT list_contains({STOP}, t)) AS x FROM v) v JOIN dom USING (nicho, formato)),
f AS (SELECT nicho, faixa, count(*) AS k FROM w GROUP BY 1, 2), g AS (SELECT nicho, faixa FROM f QUALIFY row_number() OVER (PARTITION BY nicho ORDER BY k DESC, faixa) = 1),
m AS (SELECT nicho, round(median(p), 3) AS p, floor(median(w))::BIGINT AS w, avg(rep::INT) >= 0.3 AS rep FROM w GROUP BY 1)
SELECT nicho, CASE WHEN p >= 4 AND w <= 150 THEN 'impacto_rapido' WHEN rep AND p >= 3.5 THEN 'esquete_com_hook' WHEN w >= 400 THEN 'narrativa' ELSE 'esquete' END AS estilo, faixa, w AS limite, rep AS repeticao FROM m JOIN g USING (nicho)""")
def pattern_structure(spark, d):
    rows = _features(spark, d, "formato", "faixa", "pace", "n_words", "repeticao")
    out = patterns.structure_patterns(rows, patterns.pattern_scalars(rows, wanted=()))
    e = "estrutura_geral"
    return out.select("nicho", F.col(f"{e}.estrutura_blocos").alias("estilo"), F.col(f"{e}.faixa_duracao").alias("faixa"), F.col(f"{e}.limite_palavras").cast("long").alias("limite"), F.col(f"{e}.usa_repeticao").alias("repeticao"))


def _tone(toks: str) -> str:
    hits = lambda ws: f"len(list_filter({toks}, lambda t: list_contains([{', '.join(repr(w) for w in ws)}], t)))"
    p, n = hits(W.POSITIVE_WORDS), hits(W.NEGATIVE_WORDS)
    return f"CASE WHEN coalesce(({p} - {n}) / nullif({p} + {n}, 0), 0) >= 0.05 THEN 'positivo' WHEN coalesce(({p} - {n}) / nullif({p} + {n}, 0), 0) <= -0.05 THEN 'negativo' ELSE 'neutro' END"


@query(f"""WITH {_VIDEO}, p AS (SELECT nicho, content AS w, floor(len(content) * 0.2)::INT AS a, floor(len(content) * 0.8)::INT AS b FROM v),
s AS (SELECT nicho, unnest([{{'parte': 'inicio', 'w': w[1:a]}}, {{'parte': 'meio', 'w': w[a + 1:b]}}, {{'parte': 'fim', 'w': w[b + 1:]}}], recursive := true) FROM p), t AS (SELECT nicho, parte, w, {_tone("w")} AS tom FROM s),
c AS (SELECT nicho, parte, tom, count(*) AS k FROM t GROUP BY ALL), dom AS (SELECT nicho, parte, tom FROM c QUALIFY row_number() OVER (PARTITION BY nicho, parte ORDER BY k DESC, tom) = 1),
e AS (SELECT t.nicho, t.parte, t.tom = dom.tom AS keep, unnest(w) AS term FROM t JOIN dom USING (nicho, parte)), n AS (SELECT nicho, parte, term, count(*) FILTER (keep) AS i, count(*) AS k FROM e GROUP BY ALL), x AS (SELECT nicho, parte, count(*) FILTER (i > 0) AS own FROM n GROUP BY ALL)
SELECT nicho, parte, tom, term, (CASE WHEN own < 10 THEN i + k ELSE i END)::BIGINT AS n, row_number() OVER (PARTITION BY nicho, parte ORDER BY CASE WHEN own < 10 THEN i + k ELSE i END DESC, term)::BIGINT AS rank FROM n JOIN x USING (nicho, parte) JOIN dom USING (nicho, parte) WHERE CASE WHEN own < 10 THEN i + k ELSE i END > 0 QUALIFY rank <= 10""")
def pattern_arc(spark, d):
    rows = _features(spark, d, "tom", "_content")
    scalars = patterns.pattern_scalars(rows, wanted=())
    tones = scalars.select("nicho", F.explode(F.array(*[F.struct(F.lit(p).alias("kind"), F.col(f"tom_{p}").alias("tom")) for p in patterns.ARC])).alias("t")).select("nicho", "t.*")
    out = patterns.pattern_bags(rows, scalars, bags={k: patterns.BAGS[k] for k in patterns.ARC}).join(tones, ["nicho", "kind"])
    return out.select("nicho", F.col("kind").alias("parte"), "tom", F.col("a").alias("term"), "n", F.col("rank").cast("long").alias("rank"))


#: What a stored document must hold.
REQUIRED = {f"{topic}.{name}": "structure_content" for topic, names in {"titulo": ("formula_construcao", "comprimento_alvo_chars"), "descricao": ("cta_posicao", "hashtags"), "palavras_chave": ("shorttail", "proporcao_ideal"), "postagem": ("top_3_slots",)}.items() for name in names}
REQUIRED |= {f"{topic}.{name}": "script_content" for topic, names in {"estrutura_geral": ("estrutura_blocos",), "gancho": ("exemplos_reais",), "arco_emocional": ("inicio",), "audio": ("clima_sonoro",), "cta": ("estilo",), "vocabulario_geral": ("termos_obrigatorios",)}.items() for name in names}


@query("SELECT DISTINCT lang AS nicho, 'script_content.audio.clima_sonoro,structure_content.descricao.hashtags' AS faltando FROM documents")
def pattern_validation(spark, d):
    docs = patterns.pattern_documents(videos(spark, d)).select("nicho", F.to_json("structure_content").alias("structure_content"), F.to_json("script_content").alias("script_content"))
    return patterns.missing_fields(docs, REQUIRED).select("nicho", F.array_join(F.array_sort("faltando"), ",").alias("faltando"))


_PROFILE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS coluna, count({c})::BIGINT AS n, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 3) + 0.0 AS skew FROM lineitem" for c in _PROFILE))
def profile_report(spark, d):
    rows = table(spark, d, "lineitem").select(*_PROFILE).unpivot([], list(_PROFILE), "coluna", "valor")
    out = stats.describe(rows, "valor", ["coluna"])
    return out.select("coluna", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")], (F.round("skew", 3) + 0.0).alias("skew"))


@query(f"""WITH x AS (SELECT quality, len({WS})::DOUBLE AS w, n_chars::DOUBLE AS c FROM documents JOIN labels USING (doc_id)), m AS (SELECT quality, median(w) AS w, median(c) AS c FROM x GROUP BY 1)
SELECT 'palavras' AS metrica, round(a.w, 3) AS alto, round(b.w, 3) AS baixo, round(a.w - b.w, 3) AS delta FROM m a, m b WHERE a.quality = 1 AND b.quality = 0
UNION ALL SELECT 'caracteres', round(a.c, 3), round(b.c, 3), round(a.c - b.c, 3) FROM m a, m b WHERE a.quality = 1 AND b.quality = 0""")
def contrast_profile(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = joined.select("quality", F.size(T.ws_tokens(F.col("text"))).cast("double").alias("palavras"), F.col("n_chars").cast("double").alias("caracteres"))
    long = stats.median_of(rows, {c: F.col(c) for c in ("palavras", "caracteres")}, ["quality"]).unpivot(["quality"], ["palavras", "caracteres"], "metrica", "v")
    side = lambda q: F.max(F.when(F.col("quality") == q, F.col("v")))
    out = long.groupBy("metrica").agg(side(1).alias("a"), side(0).alias("b"))
    return out.select("metrica", F.round("a", 3).alias("alto"), F.round("b", 3).alias("baixo"), F.round(F.col("a") - F.col("b"), 3).alias("delta"))


def _numbers(spark, d):
    t = F.col("text")
    rhythm = T.sentence_rhythm(t)
    return table(spark, d, "documents").select(
        "doc_id", F.size(T.ws_tokens(t)).cast("double").alias("words"), T.caps_ratio(t).alias("caps"), T.type_token_ratio(T.tokens(t)).alias("ttr"),
        T.pace(F.size(T.ws_tokens(t)), F.lit(60.0)).alias("pace"), rhythm["mean"].alias("sentence"), T.is_dialogue(t).cast("double").alias("dialogue"),
    )


@query()
def kmeans_select_k(spark, d):
    return learned.kmeans_by_silhouette(_numbers(spark, d), ["words", "caps", "ttr", "pace", "sentence", "dialogue"]).select("doc_id", "formato", "k")


@query()
def kmeans_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    latin = F.filter(T.content_tokens(F.col("text")), lambda t: t.rlike("^[a-z]{3,}$"))
    return learned.text_clusters(docs, "text", latin, "doc_id")


@query()
def rf_importance(spark, d):
    joined = _numbers(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")
    numbers = stored(spread(joined.select("words", "caps", "ttr", "sentence", "label")), "numbers")  # read several times
    found = learned.feature_importance(numbers, ["words", "caps", "ttr", "sentence"], "label")
    return found if found is not None else spark.createDataFrame([], "feature string, importance double")


@query()
def density_cluster(spark, d):
    return density.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
