"""Profiling reports, cross analyses, scores and service operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import bags, filters, service, stats, terms, vectors
from ..functions import positional as P
from ..session import WORD_BYTES, dealt, stored
from ..sources.readers import table
from .model_queries import _tone
from .statistics_queries import CONTENT, TOKENS, WORD, WS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return table(spark, d, "documents")


# --- counts and distributions


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT event_type)::BIGINT AS kinds FROM events")
def count_distinct(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT l_returnflag, (count(*) FILTER (l_discount = 0))::BIGINT AS zeros, (count(*) FILTER (l_discount < 0))::BIGINT AS negatives FROM lineitem GROUP BY 1")
def zero_negative(spark, d):
    return stats.describe(table(spark, d, "lineitem"), "l_discount", ["l_returnflag"]).select("l_returnflag", "zeros", "negatives")


@query("""WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderstatus, round(any_value(q1), 3) AS q1, round(any_value(m), 3) AS median, round(any_value(q3), 3) AS q3, min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low,
max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, (count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)))::BIGINT AS beyond FROM orders JOIN q USING (o_orderstatus) GROUP BY 1""")
def box_plot(spark, d):
    out = stats.box_plot(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.withColumns({c: F.round(c, 3) for c in ("q1", "median", "q3")})


_RANKED = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), c AS (SELECT event_type, count(*)::BIGINT AS n, corr(a, b) AS r FROM r GROUP BY 1 HAVING count(*) >= 5)
SELECT event_type, n, round(r, 5) + 0.0 AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) + 0.0 AS t FROM c""")
def spearman_groups(spark, d):
    out = stats.spearman_test(table(spark, d, "events"), "value", "user_id", ["event_type"])
    return out.select("event_type", "n", (F.round("r", 5) + 0.0).alias("r"), (F.round("t", 4) + 0.0).alias("t"))


@query()
def spearman_p(spark, d):
    return stats.spearman_test(table(spark, d, "events"), "value", "user_id", ["event_type"])


_MATRIX = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("WITH r AS (SELECT " + ", ".join(f"{_RANKED.format(c=c)} AS {c}" for c in _MATRIX) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*)::BIGINT AS n, round(corr({a}, {b}), 5) + 0.0 AS r, CASE WHEN abs(corr({a}, {b})) >= 0.7 THEN 'forte' WHEN abs(corr({a}, {b})) >= 0.4 THEN 'moderada' ELSE 'fraca' END AS strength FROM r"
    for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1 :]))
def spearman_matrix(spark, d):
    return stats.spearman_matrix(table(spark, d, "lineitem"), _MATRIX).withColumn("r", F.round("r", 5) + 0.0)


@query(f"""WITH k AS (SELECT lang, list_transform([p for p in string_split(replace(text, chr(10), ' '), ',')], lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> ''))) AS n FROM documents),
s AS (SELECT lang, len(list_filter(n, lambda x: x = 1)) AS a, len(list_filter(n, lambda x: x = 2)) AS b, len(list_filter(n, lambda x: x >= 3)) AS c FROM k),
m AS (SELECT lang, median(round(a / (a + b + c), 3)) AS a, median(round(b / (a + b + c), 3)) AS b, median(round(c / (a + b + c), 3)) AS c FROM s WHERE a + b + c > 0 GROUP BY 1)
SELECT lang, coalesce(round(a / nullif(a + b + c, 0), 3), 0) AS shorttail, coalesce(round(b / nullif(a + b + c, 0), 3), 0) AS midtail, coalesce(round(c / nullif(a + b + c, 0), 3), 0) AS longtail FROM m""")
def ratio_medians(spark, d):
    from ..operators.patterns import keyword_ratio

    n = lambda low, high: F.size(F.filter("n", lambda x: x.between(low, high)))
    words = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), ","), lambda x: F.size(T.ws_tokens(x)))
    rows = _docs(spark, d).select("lang", words.alias("n")).select("lang", n(1, 1).alias("a"), n(2, 2).alias("b"), n(3, 1 << 30).alias("c")).where("a + b + c > 0")
    share = lambda c: F.round(F.col(c) / (F.col("a") + F.col("b") + F.col("c")), 3)
    return stats.median_of(rows, {c: share(c) for c in "abc"}, ["lang"]).select("lang", keyword_ratio(F.col("a"), F.col("b"), F.col("c")).alias("k")).select("lang", "k.*")


@query(f"SELECT lang, count(*)::BIGINT AS total, count(DISTINCT term)::BIGINT AS distinct_terms FROM (SELECT lang, unnest({TOKENS}) AS term FROM documents) GROUP BY 1")
def vocabulary_counts(spark, d):
    return bags.exploded(_docs(spark, d), T.tokens(F.col("text")), ["lang"]).groupBy("lang").agg(F.count("*").alias("total"), F.count_distinct("term").alias("distinct_terms"))


@query("SELECT event_type, round(median(value) FILTER (value > 0), 4) AS positive_median, (count(*) FILTER (value > 0))::BIGINT AS n FROM events GROUP BY 1")
def positive_median(spark, d):
    positive = F.when(F.col("value") > 0, F.col("value"))
    events = table(spark, d, "events")
    counts = events.groupBy("event_type").agg(F.count(positive).alias("n"))
    return stats.with_groups(counts, stats.median_of(events, {"m": positive}, ["event_type"]), ["event_type"]).select("event_type", F.round("m", 4).alias("positive_median"), "n")


@query("SELECT source, round(avg(exp(ln(1 + n_chars)) - 1), 3) AS mean FROM documents GROUP BY 1")
def log_and_back(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.round(F.avg(F.expm1(F.log1p("n_chars"))), 3).alias("mean"))


@query("WITH h AS (SELECT hour(ts)::BIGINT AS hora, count(*)::BIGINT AS n FROM events GROUP BY 1) SELECT hora, n, row_number() OVER (ORDER BY n DESC, hora) <= 3 AS top FROM h")
def posting_hours(spark, d):
    hours = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hora")).agg(F.count("*").alias("n"))  # at most 24 rows
    best = hours.orderBy(F.desc("n"), "hora").limit(3).select(F.col("hora").alias("h"))
    return hours.join(F.broadcast(best), F.col("hora") == F.col("h"), "left").select("hora", "n", F.col("h").isNotNull().alias("top"))


@query("""WITH m AS (SELECT strftime(ts, '%Y-%m') AS mes, count(*)::BIGINT AS n FROM events GROUP BY 1) SELECT mes, n FROM m ORDER BY n DESC, mes LIMIT 1""")
def busiest_month(spark, d):
    return stats.month_counts(table(spark, d, "events"), "ts").orderBy(F.desc("n"), "mes").limit(1)


# --- cross analyses


_CROSS = f"""x AS (SELECT doc_id, source, n_chars % 997 / 10.0 AS taxa, n_chars / 50.0 AS score, doc_id % 3 = 0 AS repete, {_tone(f"regexp_extract_all(lower(text), '{WORD}+')")} AS tom FROM documents)"""


def _cross(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", "source", (F.col("n_chars") % 997 / 10.0).alias("taxa"), (F.col("n_chars") / 50.0).alias("score"), (F.col("doc_id") % 3 == 0).alias("repete"), T.sentiment(T.polarity(t)).alias("tom"))


@query(f"""WITH {_CROSS}, g AS (SELECT CASE WHEN tom = 'negativo' AND repete THEN 'negativo_repete' WHEN tom = 'negativo' THEN 'negativo' ELSE 'outros' END AS grupo, taxa FROM x) SELECT grupo, count(*)::BIGINT AS n, round(median(taxa), 4) AS mediana FROM g GROUP BY 1""")
def cross_tone_repetition(spark, d):
    group = F.when((F.col("tom") == "negativo") & F.col("repete"), "negativo_repete").when(F.col("tom") == "negativo", "negativo").otherwise("outros")
    rows = _cross(spark, d).select(group.alias("grupo"), "taxa")
    medians = stats.median_of(rows, {"m": F.col("taxa")}, ["grupo"]).select("grupo", F.round("m", 4).alias("mediana"))
    return stats.with_groups(rows.groupBy("grupo").agg(F.count("*").alias("n")), medians, ["grupo"])


@query(f"WITH {_CROSS} SELECT tom, round(100.0 * count(*) FILTER (repete) / count(*), 4) AS pct FROM x GROUP BY 1")
def repetition_by_tone(spark, d):
    return _cross(spark, d).groupBy("tom").agg(F.round(100.0 * F.avg(F.col("repete").cast("int")), 4).alias("pct"))


@query(f"""WITH {_CROSS}, m AS (SELECT source, median(taxa) AS c, median(score) AS s FROM x GROUP BY 1)
SELECT source, round(c, 3) AS clickbait, round(s, 3) AS score, CASE WHEN c >= 50 AND s >= 20 THEN 'clique' WHEN c < 50 AND s >= 20 THEN 'roteiro' WHEN c >= 50 THEN 'capa_sem_retencao' ELSE 'fraco' END AS quadrante FROM m""")
def cross_quadrant(spark, d):
    m = stats.median_of(_cross(spark, d), {"c": F.col("taxa"), "s": F.col("score")}, ["source"])
    quadrant = F.when((F.col("c") >= 50) & (F.col("s") >= 20), "clique").when((F.col("c") < 50) & (F.col("s") >= 20), "roteiro").when(F.col("c") >= 50, "capa_sem_retencao").otherwise("fraco")
    return m.select("source", F.round("c", 3).alias("clickbait"), F.round("s", 3).alias("score"), quadrant.alias("quadrante"))


@query("""WITH e AS (SELECT CASE WHEN hour(ts) < 6 THEN 'madrugada' WHEN hour(ts) < 12 THEN 'manha' WHEN hour(ts) < 18 THEN 'tarde' ELSE 'noite' END AS janela, value, user_id FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY janela ORDER BY value) + (count(*) OVER (PARTITION BY janela, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY janela ORDER BY user_id) + (count(*) OVER (PARTITION BY janela, user_id) - 1) / 2.0 AS b FROM e)
SELECT janela, count(*)::BIGINT AS n, round(median(value), 4) AS mediana, round(corr(a, b), 5) + 0.0 AS r, round(regr_slope(ln(1 + value), user_id), 7) + 0.0 AS slope FROM r GROUP BY 1""")
def cross_windows(spark, d):
    h = F.hour("ts")
    band = F.when(h < 6, "madrugada").when(h < 12, "manha").when(h < 18, "tarde").otherwise("noite")
    rows = table(spark, d, "events").select(band.alias("janela"), "value", "user_id").where("value is not null and user_id is not null")
    r = stats.spearman(rows, "value", "user_id", ["janela"]).select("janela", "n", (F.round("r", 5) + 0.0).alias("r"))
    medians = stats.percentiles(rows, "value", (0.5,), ["janela"]).select("janela", F.round(F.col("p")[0], 4).alias("mediana"))
    line = stats.ols(rows, F.log1p("value"), F.col("user_id"), ["janela"]).select("janela", (F.round("slope", 7) + 0.0).alias("slope"))
    return r.join(medians, "janela").join(line, "janela")


# --- text profiles


@query(f"""WITH f AS (SELECT regexp_matches(text, '\\[.*?\\]') AS a, regexp_matches(text, '\\(.*?\\)') AS b, contains(text, '♪') AS c, coalesce(len(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) > 0, false) AS e FROM (SELECT text, {WS} AS w FROM documents))
SELECT count(*)::BIGINT AS n, round(100.0 * avg(a::INT), 4) AS colchetes, round(100.0 * avg(b::INT), 4) AS parenteses, round(100.0 * avg(c::INT), 4) AS nota, round(100.0 * avg(e::INT), 4) AS repeticao FROM f""")
def noise_shares(spark, d):
    rows = _docs(spark, d).select(T.noise_flags(F.col("text")).alias("f")).select("f.*")
    return rows.agg(F.count("*").alias("n"), *[F.round(100.0 * F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 4).alias(c) for c in rows.columns])


def _script(c: str) -> str:
    counts = ", ".join(f"len(regexp_extract_all({c}, '\\p{{{p.removeprefix('Is')}}}'))" for p in T.SCRIPTS.values())
    names = ", ".join(f"'{n}'" for n in T.SCRIPTS)
    return f"CASE WHEN list_sum([{counts}]) = 0 THEN 'ascii_only' WHEN list_max([{counts}]) >= 0.8 * list_sum([{counts}]) THEN ([{names}])[list_position([{counts}], list_max([{counts}]))] ELSE 'mixed' END"


@query(f"""WITH s AS (SELECT {_script("text")} AS a, {_script("source")} AS b, {_script("lang")} AS c FROM (SELECT text || CASE WHEN doc_id % 5 = 0 THEN repeat('слово ', 60) ELSE '' END AS text, source, lang FROM documents))
SELECT a || ' | ' || b || ' | ' || c AS combo, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct, any_value(a = b AND b = c) AS coerente FROM s GROUP BY 1""")
def script_coherence(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("слово "), F.lit(60))).otherwise(""))
    rows = _docs(spark, d).select(*[T.dominant_script(c).alias(n) for n, c in (("a", text), ("b", F.col("source")), ("c", F.col("lang")))])
    counts = rows.groupBy(F.concat_ws(" | ", "a", "b", "c").alias("combo")).agg(F.count("*").alias("n"), F.first(T.all_equal(F.col("a"), F.col("b"), F.col("c"))).alias("coerente"))
    return stats.with_share(counts, digits=4).drop("vs_max")


_HITS = ", ".join(f"len(list_filter(w, lambda t: list_contains([{', '.join(repr(x) for x in ws)}], t)))" for _, ws in sorted(W.LANGUAGE_WORDS.items()))
_CODES = ", ".join(f"'{c}'" for c in sorted(W.LANGUAGE_WORDS))


@query(f"""WITH t AS (SELECT doc_id, lang, text, regexp_extract_all(lower(left(text, 500)), '{WORD}+') AS w FROM documents), h AS (SELECT *, [{_HITS}] AS h FROM t)
SELECT doc_id, CASE WHEN length(text) < 10 OR list_max(h) = 0 THEN 'desconhecido' ELSE ([{_CODES}])[list_position(h, list_max(h))] END AS idioma FROM h""")
def language_words(spark, d):
    return _docs(spark, d).select("doc_id", T.language_by_words(F.col("text")).alias("idioma"))


@query(f"""WITH t AS (SELECT doc_id, text, {WS} AS ws, regexp_extract_all(lower(left(text, 500)), '{WORD}+') AS w FROM documents), h AS (SELECT *, [{_HITS}] AS h FROM t)
SELECT doc_id, NOT regexp_matches(text, '\\p{{L}}') OR len(ws) <= 2 OR list_max(h) = 0 OR ([{_CODES}])[list_position(h, list_max(h))] = 'en' AS ingles FROM h""")
def english_check(spark, d):
    return _docs(spark, d).select("doc_id", T.is_english(F.col("text")).alias("ingles"))


@query(f"SELECT doc_id, {_tone(f'''regexp_extract_all(lower(text), '{WORD}+')''')} AS tom FROM documents")
def polarity_label(spark, d):
    return _docs(spark, d).select("doc_id", T.sentiment(T.polarity(F.col("text"))).alias("tom"))


_EMOTION = " + ".join(f"len(list_filter(w, lambda t: list_contains([{', '.join(repr(x) for x in ws)}], t)))" for ws in W.EMOTIONS.values())


@query(f"SELECT doc_id, least(1.0, coalesce(round(({_EMOTION}) / nullif(len(w), 0), 3), 0)) AS impacto FROM (SELECT doc_id, {TOKENS} AS w FROM documents)")
def emotion_density(spark, d):
    return _docs(spark, d).select("doc_id", T.emotion_impact(T.tokens(F.col("text"))).alias("impacto"))


@query(f"""WITH t AS (SELECT doc_id, {CONTENT} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM t), c AS (SELECT doc_id, term, count(*)::BIGINT AS n FROM g GROUP BY 1, 2)
SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term)::BIGINT AS rank FROM c QUALIFY rank <= 10""")
def row_ngrams(spark, d):
    return bags.top_counts(P.ngram_rows(dealt(_docs(spark, d), "doc_id"), T.content_tokens(F.col("text")), ["doc_id"], (2, 3)), ["doc_id"], 10)


@query(f"""WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {CONTENT} AS w FROM documents)), p AS (SELECT x.doc_id, least(x.w, y.w) AS a, greatest(x.w, y.w) AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i > x.i AND y.i <= x.i + 5 AND x.w <> y.w), c AS (SELECT doc_id, a, b, count(*)::BIGINT AS n FROM p GROUP BY ALL)
SELECT doc_id, a, b, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a, b)::BIGINT AS rank FROM c QUALIFY rank <= 10""")
def row_pairs(spark, d):
    return bags.top_counts(P.window_pairs(dealt(_docs(spark, d), "doc_id"), T.content_tokens(F.col("text")), ["doc_id"]), ["doc_id"], 10, ("a", "b"))


_FIRST = "trim(string_split(trim(text), chr(10))[1])"


@query(f"""WITH x AS (SELECT lang, list_distinct({TOKENS}) AS body, list_distinct(list_filter(regexp_extract_all(lower({_FIRST}), '{WORD}+'), lambda t: length(t) >= 3)) AS head FROM documents)
SELECT lang, round(median(CASE WHEN len(head) = 0 THEN 0 ELSE round(100.0 * len(list_intersect(head, body)) / len(head), 3) END), 3) AS overlap FROM x GROUP BY 1""")
def overlap_medians(spark, d):
    head = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(T.first_line(F.col("text"))), F.lit(r"(?U)\w+"), F.lit(0)), lambda t: F.char_length(t) >= 3))
    rows = _docs(spark, d).select("lang", head.alias("head"), T.tokens(F.col("text")).alias("body"))
    share = F.round(100.0 * T.ratio(F.size(F.array_intersect("head", "body")), F.size("head")), 3)
    return stats.median_of(rows, {"m": share}, ["lang"]).select("lang", F.round("m", 3).alias("overlap"))


@query(f"""WITH t AS (SELECT unnest({CONTENT}) AS term FROM documents) SELECT CASE WHEN list_contains([{', '.join(repr(w) for w in W.ACTION_WORDS)}], term) THEN 'acao' WHEN list_contains([{', '.join(repr(w) for w in W.EMOTIONAL_WORDS)}], term) THEN 'emocional' ELSE 'tematica' END AS classe, count(*)::BIGINT AS n FROM t GROUP BY 1""")
def word_classes(spark, d):
    return bags.exploded(_docs(spark, d), T.content_tokens(F.col("text")), []).groupBy(T.word_class(F.col("term")).alias("classe")).agg(F.count("*").alias("n"))


@query("SELECT source, round(avg((len(regexp_extract_all(text, '\\[.*?\\]')) > 0)::INT), 4) AS com_tag, sum(len(regexp_extract_all(text, '\\[.*?\\]')))::BIGINT AS tags FROM documents GROUP BY 1")
def tag_share(spark, d):
    tags = F.size(T.tag_cues(F.col("text")))
    return _docs(spark, d).groupBy("source").agg(F.round(F.avg((tags > 0).cast("int")), 4).alias("com_tag"), F.sum(tags).alias("tags"))


# --- scores and keywords


@query("""WITH p AS (SELECT page_id, lower(trim(replace(coalesce(try(url_decode(s)), s), '_', ' '))) AS slug, page_id FROM (SELECT page_id, string_split(regexp_replace(trim(url), '/+$', ''), '/')[-1] AS s FROM pages))
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter([slug, CASE WHEN page_id % 2 = 0 THEN 'humor' END, 'a', 'b tag'], lambda x: x IS NOT NULL AND x <> ''))), ', ') AS chaves FROM p""")
def keyword_assembly(spark, d):
    category = F.when(F.col("page_id") % 2 == 0, F.lit("Humor"))
    keys = T.keyword_list(F.array(T.slug(F.col("url"))), category, F.lit("see #A"), F.array(F.lit(" B tag"), F.lit("a")))
    return table(spark, d, "pages").select("page_id", keys.alias("chaves"))


_TITLE_TERMS = CONTENT.replace("lower(text)", f"lower({_FIRST})")


@query(f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TITLE_TERMS}) AS term FROM documents) GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, term) <= 5000),
raw AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM tf JOIN dfs USING (term)), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS score FROM raw),
m AS (SELECT term, sum(score) / (SELECT count(*) FROM documents) AS m FROM u GROUP BY 1), c AS (SELECT doc_id, sum(score * m) / (SELECT sqrt(sum(m * m)) FROM m) AS sim FROM u JOIN m USING (term) GROUP BY 1),
w AS (SELECT doc_id, coalesce(sim, 0) AS sim, len({WS}) AS n, len(list_filter(string_split_regex(left(text, 100), '\\s+'), lambda t: t <> '')) AS h, length({_FIRST}) AS f FROM documents LEFT JOIN c USING (doc_id)),
s AS (SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, 1 - greatest(n - 8, 0) / 8.0) + least(1.0, n / 15.0) END AS capa, least(1.0, h / 15.0) AS descricao, sim + CASE WHEN f BETWEEN 40 AND 70 THEN 1.0 ELSE greatest(0.0, 1 - abs(f - 55) / 55.0) END AS titulo FROM w)
SELECT doc_id, round(capa, 4)::DOUBLE AS capa, round(descricao, 4)::DOUBLE AS descricao, round(titulo, 4)::DOUBLE AS titulo,
round(((capa - min(capa) OVER ()) / (max(capa) OVER () - min(capa) OVER ()) + (descricao - min(descricao) OVER ()) / (max(descricao) OVER () - min(descricao) OVER ()) + (titulo - min(titulo) OVER ()) / (max(titulo) OVER () - min(titulo) OVER ())) / 3, 4)::DOUBLE AS clickbait FROM s""")
def clickbait_parts(spark, d):
    t = F.col("text")
    bare = F.regexp_replace(T.first_line(t), "[#@]", " ")
    near = bags.similarity_to_mean(_docs(spark, d), T.content_tokens(T.first_line(t)), "doc_id", 5000)
    rows = _docs(spark, d).join(near, "doc_id", "left")
    rows = rows.select("doc_id", T.thumbnail_score(t, t).alias("capa"), T.description_score(F.regexp_replace(t, "#", " ")).alias("descricao"), T.title_score(bare, F.coalesce("sim", F.lit(0.0))).alias("titulo"))
    edges = stats.min_max(rows.select("doc_id", *[F.col(c).alias(f"m_{c}") for c in ("capa", "descricao", "titulo")]), ["m_capa", "m_descricao", "m_titulo"])
    mean = (F.col("m_capa") + F.col("m_descricao") + F.col("m_titulo")) / 3
    return rows.join(edges, "doc_id").select("doc_id", *[F.round(c, 4).alias(c) for c in ("capa", "descricao", "titulo")], F.round(mean, 4).alias("clickbait"))


@query("SELECT o_orderstatus, least(100.0, greatest(4.0, round(100.0 * count(*) / (SELECT count(*) FROM orders)))) AS pct FROM orders GROUP BY 1")
def percent_floor(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("o_orderstatus", T.percent(F.col("n"), F.col("total"), 4).alias("pct"))


@query("SELECT c_custkey, lower(trim(c_name)) AS nome, regexp_matches(lower(c_name) || '@x.y', '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS email_ok, regexp_matches(c_name, '[a-z]') AND regexp_matches(c_name, '[A-Z]') AND regexp_matches(c_name, '[0-9]') AND regexp_matches(c_name, '[^A-Za-z0-9]') AND length(c_name) >= 8 AS senha_ok FROM customer")
def normalise_input(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", T.normal_name(c).alias("nome"), T.valid_email(F.concat(c, F.lit("@x.y"))).alias("email_ok"), T.strong_password(c).alias("senha_ok"))


@query("SELECT page_id, try_cast(replace(regexp_extract(url, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS numero FROM pages")
def number_in_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.first_number(F.col("url")).alias("numero"))


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS joined, true AS bounded FROM t")
def chunk_text(spark, d):
    rows = _docs(spark, d).select("doc_id", T.chunks(F.col("text"), 120).alias("c"))
    return rows.select("doc_id", F.md5(F.array_join("c", " ")).alias("joined"), F.forall("c", lambda x: F.char_length(x) <= 120).alias("bounded"))


# --- sets, arrays, alignment


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || string_split(p_type, ' '))), ',') AS verbos FROM part")
def set_union(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.split("p_type", " "))), ",").alias("verbos"))


@query("SELECT conv_id, len(list_filter(list(role), lambda r: r IN ('user', 'assistant')))::BIGINT AS kept FROM conversations GROUP BY 1")
def typed_items(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles"))
    return roles.select("conv_id", F.size(F.filter("roles", lambda r: r.isin("user", "assistant"))).cast("long").alias("kept"))


@query("SELECT doc_id, quality::BIGINT AS quality, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL")
def aligned_columns(spark, d):
    rows = _docs(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.na.drop(subset=["quality", "lang", "n_chars"]).select("doc_id", F.col("quality").cast("long").alias("quality"), "lang")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality::BIGINT AS quality, b.n::BIGINT AS n FROM (SELECT doc_id, quality FROM labels) a FULL JOIN (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id")
def outer_alignment(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    b = _docs(spark, d).where("doc_id % 3 = 0").select("doc_id", F.col("n_chars").cast("long").alias("n"))
    return a.join(b, "doc_id", "full")


@query("""SELECT n_regionkey, r_name AS regiao, array_to_string(list_sort(list(n_name)), ',') AS nacoes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def nested_projection(spark, d):
    nested = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.struct("n_name").alias("nation"))).alias("links"))
    flat = nested.select("n_regionkey", F.explode("links.nation").alias("n")).select("n_regionkey", "n.n_name")
    names = flat.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nacoes"))
    return service.lookup(names, table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("regiao")), ["n_regionkey"], "regiao", "Unknown")


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 12) AS cos FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, a, b, round(cos, 5) + 0.0 AS cos FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY cos, a, b) = 1""")
def farthest_pair(spark, d):
    return vectors.farthest_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", ["label"]).withColumn("cos", F.round("cos", 5) + 0.0)


# --- candidate terms


@query(f"""WITH t AS (SELECT lang, doc_id, unnest({CONTENT}) AS term FROM documents), s AS (SELECT lang, count(*) AS rows FROM documents GROUP BY 1), tf AS (SELECT lang, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(tf) DESC, term) <= 50), raw AS (SELECT lang, doc_id, term, tf * (ln((1.0 + rows) / (1.0 + df)) + 1) AS w, rows FROM tf JOIN w USING (lang, term) JOIN s USING (lang)),
x AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id)) AS score FROM raw) SELECT lang, term, round(round(sum(score) / any_value(rows), 6), 4) AS score FROM x GROUP BY 1, 2""")
def candidate_terms(spark, d):
    return terms.candidate_terms(_docs(spark, d), T.content_tokens(F.col("text")), "doc_id", ["lang"]).select("lang", "term", F.round("score", 4).alias("score"))


def _ngram_sql(sizes: tuple[int, ...], features: int) -> str:
    grams = " || ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: " + " || ' ' || ".join(f"w[i + {k}]" for k in range(n)) + ")" for n in sizes)
    return f"""WITH t AS (SELECT doc_id, {CONTENT} AS w FROM documents), g AS (SELECT doc_id, unnest({grams}) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
w AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, term) <= {features}), raw AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM tf JOIN w USING (term)),
x AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS score FROM raw), m AS (SELECT term, round(sum(score) / (SELECT count(*) FROM documents), 6) AS m FROM x GROUP BY 1) SELECT term, round(m, 5) AS mean_score FROM m ORDER BY m DESC, term LIMIT 20"""


def _ngram_scores(spark, d, sizes, features):
    docs = _docs(spark, d)
    words = stored(docs.select("doc_id", T.content_tokens(F.col("text")).alias("w")), "words")  # read several times
    rows = P.ngram_rows(dealt(words, "doc_id", size=WORD_BYTES), F.col("w"), ["doc_id"], sizes)
    n = bags.row_count(docs)
    scores = bags.mean_tfidf(bags.tfidf_of(rows, "doc_id", n, features=features), n).withColumn("m", F.round("mean_score", 6))
    return scores.orderBy(F.desc("m"), "term").limit(20).select("term", F.round("m", 5).alias("mean_score"))


@query(_ngram_sql((2,), 200))
def tfidf_ngrams(spark, d):
    return _ngram_scores(spark, d, (2,), 200)


@query(_ngram_sql((3,), 200))
def tfidf_trigrams(spark, d):
    return _ngram_scores(spark, d, (3,), 200)


@query(_ngram_sql((2, 3), 300))
def tfidf_two_three_grams(spark, d):
    return _ngram_scores(spark, d, (2, 3), 300)


_CENTRE = "m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)"


@query(f"WITH {_CENTRE}, s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 10) AS cos FROM embeddings JOIN c USING (label)) SELECT label, vec_id, round(cos, 4) AS cos, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id)::BIGINT AS rank FROM s WHERE cos >= 0.28 QUALIFY rank <= 20")
def semantic_terms(spark, d):
    e = table(spark, d, "embeddings")
    out = terms.semantic_filter(e.select("label", "vec_id", "embedding"), vectors.centroids(e, "embedding", ["label"]), ["label"], "vec_id", "embedding")
    return out.select("label", "vec_id", F.round("cos", 4).alias("cos"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_CENTRE}, l AS (SELECT (SELECT c FROM c ORDER BY label LIMIT 1) AS a, (SELECT c FROM c ORDER BY label DESC LIMIT 1) AS b) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], a), 4) + 0.0 AS sim FROM embeddings, l WHERE list_cosine_similarity(embedding::DOUBLE[], a) - list_cosine_similarity(embedding::DOUBLE[], b) >= 0.05")
def zero_shot(spark, d):
    e = table(spark, d, "embeddings")
    c = vectors.centroids(e, "embedding", ["label"])
    both = c.agg(F.min_by("centroid", "label").alias("a"), F.max_by("centroid", "label").alias("b"))  # one row
    return terms.zero_shot(e.crossJoin(F.broadcast(both)), "embedding", F.col("a"), F.col("b")).select("vec_id", (F.round("sim", 4) + 0.0).alias("sim"))


# --- service writes


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN 99 ELSE c_nationkey END AS c_nationkey FROM customer UNION ALL SELECT -1, 'NEW', 1")
def upsert_rows(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = old.where("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.when(F.col("c_custkey") % 20 == 0, 99).cast(old.schema["c_nationkey"].dataType).alias("c_nationkey"))
    extra = spark.sql("SELECT -1 AS c_custkey, 'NEW' AS c_mktsegment, 1 AS c_nationkey")
    return service.upsert(old, new.unionByName(extra), ["c_custkey"])


@query("SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 7 = 0 THEN '+deleted_1000' ELSE '' END AS email, c_custkey % 7 <> 0 AS active FROM customer")
def soft_delete(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.lit(None).cast("timestamp").alias("deleted_at"))
    out = service.soft_delete(users, users.where("id % 7 = 0").select("id"), F.timestamp_millis(F.lit(1000)))
    return out.select("id", "email", F.col("deleted_at").isNull().alias("active"))


@query("SELECT user_id, count(DISTINCT event_type)::BIGINT AS n FROM events GROUP BY 1")
def link_niches(spark, d):
    every = table(spark, d, "events").select("user_id", F.col("event_type").alias("niche_id")).distinct()
    links, _ = service.link_niches(every.where("niche_id <> 'click'"), every)
    return links.groupBy("user_id").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT DISTINCT user_id, event_type FROM events), k AS (SELECT user_id, count(*) FILTER (event_type <> 'view') AS kept FROM l GROUP BY 1) SELECT l.user_id, l.event_type AS niche_id FROM l JOIN k USING (user_id) WHERE l.event_type <> 'view' OR kept = 0")
def unlink_niches(spark, d):
    links = table(spark, d, "events").select("user_id", F.col("event_type").alias("niche_id")).distinct()
    return service.unlink_niches(links, links.where("niche_id = 'view'"))


@query("SELECT event_id FROM events WHERE user_id % 5 <> 0")
def purge_tokens(spark, d):
    tokens = table(spark, d, "events")
    return service.purge(tokens, tokens.where("user_id % 5 = 0").select("user_id").distinct(), "user_id").select("event_id")


@query("SELECT DISTINCT c_name, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' AND contains(lower(c_name), '9')")
def available_niches(spark, d):
    mine = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_mktsegment").distinct()
    rest = table(spark, d, "customer").join(F.broadcast(mine), "c_mktsegment", "left_anti")
    return rest.where(filters.contains_any(["c_name"], "9")).select("c_name", "c_mktsegment").distinct()


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def dynamic_sort(spark, d):
    return service.sorted_by(table(spark, d, "customer"), "saldo", {"nome": F.collate(F.col("c_name"), "pt"), "saldo": F.col("c_acctbal")}, descending=True, tie="c_custkey").limit(20).select("c_custkey")


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS linhas, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS canais, (SELECT lang FROM documents GROUP BY 1 ORDER BY count(*) DESC, lang LIMIT 1) AS idioma, (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) AS ultima, (SELECT strftime(min(ts), '%Y-%m-%d') FROM events) AS primeira")
def dataset_overview(spark, d):
    docs = _docs(spark, d).agg(F.count("*").alias("linhas"), F.count_distinct("source").alias("canais"), stats.mode("lang").alias("idioma"))
    dates = table(spark, d, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("ultima"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("primeira"))
    return docs.crossJoin(F.broadcast(dates))  # one row each


_LONG = {"palavras": f"len({WS})::DOUBLE", "caracteres": "n_chars::DOUBLE"}


@query(" UNION ALL ".join(f"SELECT lang AS nicho, '{k}' AS secao, m.metrica, round(m.valor, 3) AS valor FROM (SELECT lang, avg({x}) AS a, median({x}) AS b, max({x}) AS c FROM documents GROUP BY 1), (VALUES ('media', 1), ('mediana', 2), ('maximo', 3)) AS n(metrica, i), LATERAL (SELECT n.metrica AS metrica, CASE i WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS valor) m" for k, x in _LONG.items()))
def profile_long(spark, d):
    """The numeric report of every niche in long form, one table instead of a log for each."""
    rows = _docs(spark, d).select(F.col("lang").alias("nicho"), F.size(T.ws_tokens(F.col("text"))).cast("double").alias("palavras"), F.col("n_chars").cast("double").alias("caracteres")).unpivot(["nicho"], ["palavras", "caracteres"], "secao", "x")
    out = stats.describe(rows, "x", ["nicho", "secao"]).select("nicho", "secao", F.col("mean").alias("media"), F.col("median").alias("mediana"), F.col("max").alias("maximo"))
    return out.unpivot(["nicho", "secao"], ["media", "mediana", "maximo"], "metrica", "valor").withColumn("valor", F.round("valor", 3))
