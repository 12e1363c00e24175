"""Statistics, bags and positional operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import positional as P
from ..functions import text as T
from ..functions import words as W
from ..operators import bags, stats
from ..session import spread, stored
from ..sources.readers import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: SQL forms of the tokenisers in functions.text.
WORD = r"[\p{L}\p{M}\p{N}_]"
WS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
TOKENS = rf"list_filter(regexp_extract_all(regexp_replace(lower(text), 'https?://\S+|\[[^\]]*\]|\([^)]*\)|[#@]{WORD}+', ' ', 'g'), '{WORD}+'), lambda t: length(t) >= 3)"
STOP = "[" + ", ".join("'" + w + "'" for w in W.STOP_WORDS) + "]"
CONTENT = f"list_filter({TOKENS}, lambda t: NOT list_contains({STOP}, t))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""SELECT l_returnflag, count(l_quantity)::BIGINT AS n, round(avg(l_extendedprice), 3) AS mean, round(median(l_extendedprice), 3) AS median, round(stddev_samp(l_extendedprice), 3) AS std,
min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 3) AS q1, round(quantile_cont(l_extendedprice, 0.75), 3) AS q3,
round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 3) AS iqr, round(skewness(l_extendedprice), 4) AS skew, round(kurtosis(l_extendedprice), 4) AS kurtosis,
round(stddev_samp(l_extendedprice) / avg(l_extendedprice) * 100, 4) AS cv FROM lineitem GROUP BY 1""")
def describe_numeric(spark, d):
    out = stats.describe(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]).drop("zeros", "negatives")
    return rounded(rounded(out, 3, "mean", "median", "std", "q1", "q3", "iqr"), 4, "skew", "kurtosis", "cv")


@query("""WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, round(any_value(a - 1.5 * (b - a)), 3) AS low, round(any_value(b + 1.5 * (b - a)), 3) AS high, count(*)::BIGINT AS n,
(count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)))::BIGINT AS outliers,
round(100.0 * count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) / count(*), 4) AS share,
array_to_string(list_transform(list_slice(list_reverse_sort(list(o_totalprice)), 1, 3), lambda x: round(x)::BIGINT::VARCHAR), ',') AS largest FROM orders JOIN q USING (o_orderpriority) GROUP BY 1""")
def tukey_outliers(spark, d):
    out = rounded(stats.tukey(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), 3, "low", "high")
    return out.withColumn("largest", F.array_join(F.transform("largest", lambda x: F.round(x).cast("long").cast("string")), ","))


_COMPLETE = ("doc_id", "text", "lang", "source", "quality")


@query("WITH j AS (SELECT d.*, quality FROM documents d LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, count(*)::BIGINT AS n, (count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = ''))::BIGINT AS vazios, round(100.0 * count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') / count(*), 4) AS percentual, "
    f"CASE WHEN count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') = 0 THEN 'OK' WHEN 100.0 * count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') / count(*) <= 10 THEN 'ATENCAO' ELSE 'CRITICO' END AS status FROM j"
    for c in _COMPLETE))
def completeness(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return stats.completeness(joined, _COMPLETE)


@query("SELECT quality::BIGINT AS quality, count(*)::BIGINT AS n, (count(*) FILTER (toxic = 1))::BIGINT AS n_toxic, round(100.0 * count(*) FILTER (toxic = 1) / count(*), 4) AS pct_toxic FROM labels GROUP BY 1")
def bool_share(spark, d):
    return stats.shares(table(spark, d, "labels").withColumn("quality", F.col("quality").cast("long")), {"toxic": F.col("toxic") == 1}, ["quality"])


@query("""WITH b AS (SELECT source, CASE WHEN n_chars <= 500 THEN 'curto' WHEN n_chars < 1800 THEN 'medio' ELSE 'longo' END AS faixa, count(*)::BIGINT AS n FROM documents GROUP BY ALL)
SELECT source, arg_max(faixa, n * 10 + CASE faixa WHEN 'curto' THEN 3 WHEN 'medio' THEN 2 ELSE 1 END) AS regime, sum(n)::BIGINT AS n FROM b GROUP BY 1""")
def band_share(spark, d):
    n = F.col("n_chars")
    bands = {"curto": n <= 500, "medio": (n > 500) & (n < 1800), "longo": n >= 1800}
    out = stats.shares(table(spark, d, "documents"), bands, ["source"])
    best = F.greatest("n_curto", "n_medio", "n_longo")
    return out.select("source", F.when(F.col("n_curto") == best, "curto").when(F.col("n_medio") == best, "medio").otherwise("longo").alias("regime"), "n")


@query("""SELECT lang, round(quantile_cont(n_chars, 0.1), 3) AS p10, round(quantile_cont(n_chars, 0.25), 3) AS p25, round(quantile_cont(n_chars, 0.5), 3) AS p50,
round(quantile_cont(n_chars, 0.75), 3) AS p75, round(quantile_cont(n_chars, 0.9), 3) AS p90 FROM documents GROUP BY 1""")
def percentile_battery(spark, d):
    p = stats.percentiles(table(spark, d, "documents"), "n_chars", (0.1, 0.25, 0.5, 0.75, 0.9), ["lang"])
    return p.select("lang", *[F.round(F.col("p")[i], 3).alias(f"p{q}") for i, q in enumerate((10, 25, 50, 75, 90))])


@query("""SELECT source, lang AS mode FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE r = 1""")
def mode_by_group(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(stats.mode("lang").alias("mode"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, (list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority))::BIGINT AS place FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') GROUP BY 1")
def ordered_counts(spark, d):
    return stats.counts_in_order(table(spark, d, "orders"), "o_orderpriority", _PRIORITIES)


_BAND = "CASE WHEN hour(ts) < 6 THEN 'madrugada' WHEN hour(ts) < 12 THEN 'manha' WHEN hour(ts) < 18 THEN 'tarde' ELSE 'noite' END"
_BANDS = ("madrugada", "manha", "tarde", "noite")


def _slots(spark, d):
    h = F.hour("ts")
    band = F.when(h < 6, "madrugada").when(h < 12, "manha").when(h < 18, "tarde").otherwise("noite")
    return table(spark, d, "events").select(F.date_format("ts", "EEEE").alias("dia"), band.alias("janela"))


@query("SELECT dayname(ts) AS dia, " + ", ".join(f"(count(*) FILTER ({_BAND} = '{b}'))::BIGINT AS {b}" for b in _BANDS) + " FROM events GROUP BY 1")
def pivot_day_window(spark, d):
    return stats.pivot_counts(_slots(spark, d), "dia", "janela", _BANDS)


@query(f"SELECT dayname(ts) AS dia, {_BAND} AS coluna, count(*)::BIGINT AS n, 'Publicar ' || dayname(ts) || ' (' || {_BAND} || ')' AS justificativa FROM events GROUP BY ALL ORDER BY n DESC, dia, coluna LIMIT 3")
def top_slots(spark, d):
    top = stats.unpivot_top(stats.pivot_counts(_slots(spark, d), "dia", "janela", _BANDS), "dia", _BANDS, 3)
    return top.withColumn("justificativa", F.format_string("Publicar %s (%s)", "dia", "coluna"))


@query("SELECT source, " + ", ".join(f"round(100.0 * count(*) FILTER (lang = '{v}') / count(*) FILTER (lang IN ('en', 'fr', 'de', 'es')), 4) AS {v}" for v in ("en", "fr", "de", "es")) + " FROM documents GROUP BY 1")
def crosstab_pct(spark, d):
    return stats.crosstab_percent(table(spark, d, "documents"), "source", "lang", ("en", "fr", "de", "es"))


@query("SELECT l_returnflag, l_linestatus, round(median(l_quantity), 3) AS mediana FROM lineitem GROUP BY 1, 2")
def median_two_keys(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    return rounded(stats.median_of(table(spark, d, "lineitem"), {"mediana": F.col("l_quantity")}, keys), 3, "mediana")


@query("SELECT strftime(ts, '%Y-%m') AS mes, count(*)::BIGINT AS n FROM events GROUP BY 1")
def month_growth(spark, d):
    return stats.month_counts(table(spark, d, "events"), "ts")


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def stats_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)
SELECT event_type, count(*)::BIGINT AS n, round(corr(a, b), 5) + 0.0 AS r, CASE WHEN abs(corr(a, b)) >= 0.7 THEN 'forte' WHEN abs(corr(a, b)) >= 0.4 THEN 'moderada' ELSE 'fraca' END AS strength FROM r GROUP BY 1""")
def spearman_pairs(spark, d):
    return stats.spearman(table(spark, d, "events"), "value", "user_id", ["event_type"]).drop("t").withColumn("r", F.round("r", 5) + 0.0)


@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(regr_slope(ln(1 + l_extendedprice), l_quantity), 6) + 0.0 AS slope, round(regr_intercept(ln(1 + l_extendedprice), l_quantity), 6) + 0.0 AS intercept FROM lineitem GROUP BY 1")
def ols_by_group(spark, d):
    out = rounded(stats.ols(table(spark, d, "lineitem"), F.log1p("l_extendedprice"), F.col("l_quantity"), ["l_returnflag"]), 6, "slope", "intercept")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("slope", "intercept")})


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT least(floor((o_totalprice - lo) / (hi - lo) * 30), 29)::BIGINT AS bin, count(*)::BIGINT AS n FROM orders, e GROUP BY 1""")
def histogram(spark, d):
    return stats.histogram(table(spark, d, "orders"), "o_totalprice", 30)


@query("SELECT o_orderstatus, round(sum(o_totalprice) / count(*) / avg(o_custkey) * 100, 4) AS ratio FROM orders GROUP BY 1")
def ratio_of_means(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice") / F.avg("o_custkey") * 100, 4).alias("ratio"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS p_size FROM part")
def minmax_scale(spark, d):
    return rounded(stats.min_max(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]), 6, "p_retailprice", "p_size")


_TERMS = f"SELECT doc_id, lang, unnest({CONTENT}) AS term FROM documents"
_CONTENT = T.content_tokens


@query(f"""WITH c AS (SELECT lang, term, count(*)::BIGINT AS n FROM ({_TERMS}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c)
SELECT lang, term, n, rank::BIGINT AS rank FROM r WHERE rank <= 20""")
def top_terms_per_group(spark, d):
    return bags.top_terms(table(spark, d, "documents"), _CONTENT(F.col("text")), ["lang"], 20)


@query(f"""WITH c AS (SELECT term, count(*)::BIGINT AS n FROM ({_TERMS}) GROUP BY 1) SELECT term, n, row_number() OVER (ORDER BY n DESC, term)::BIGINT AS rank FROM c QUALIFY rank <= 200""")
def zipf(spark, d):
    counts = bags.term_counts(table(spark, d, "documents"), _CONTENT(F.col("text")), [])
    top = counts.orderBy(F.desc("n"), "term").limit(200)
    return stats.top_rows(top.withColumn("_one", F.lit(1)), ["_one"], [F.desc("n"), F.asc("term")], 200, rank="rank").drop("_one")


@query(f"""WITH b AS (SELECT lang, coalesce(quality, 0) = 1 AS keep, unnest({CONTENT}) AS term FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT lang, term, count(*) FILTER (keep) AS i, count(*) AS w FROM b GROUP BY 1, 2), s AS (SELECT lang, count(*) FILTER (i > 0) AS k FROM c GROUP BY 1),
n AS (SELECT lang, term, (CASE WHEN k < 15 THEN i + w ELSE i END)::BIGINT AS n FROM c JOIN s USING (lang))
SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::BIGINT AS rank FROM n WHERE n > 0 QUALIFY rank <= 15""")
def filtered_bag_fallback(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("good", F.coalesce("quality", F.lit(0)) == 1)
    return bags.filtered_bag(joined, _CONTENT(F.col("text")), F.col("good"), ["lang"], 15)


@query(f"""WITH c AS (SELECT lang, term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS rows FROM ({_TERMS}) GROUP BY 1, 2)
SELECT lang, term, n, rows, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::BIGINT AS rank FROM c QUALIFY rank <= 10""")
def dispersion(spark, d):
    return bags.dispersion(table(spark, d, "documents"), _CONTENT(F.col("text")), "doc_id", ["lang"], 10)


@query(f"""WITH t AS (SELECT doc_id, {CONTENT} AS w FROM documents), c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM t) GROUP BY 1, 2), m AS (SELECT doc_id, max(n) AS n FROM c GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS max_repeat, coalesce(n, 0) >= 5 AS repeats FROM t LEFT JOIN m USING (doc_id)""")
def max_repeat(spark, d):
    most = P.max_repeat(_CONTENT(F.col("text"))).cast("long")
    return table(spark, d, "documents").select("doc_id", most.alias("max_repeat")).withColumn("repeats", F.col("max_repeat") >= 5)


@query(f"""WITH e AS ({_TERMS}), c AS (SELECT lang, term, count(*) AS n FROM e GROUP BY 1, 2), top AS (SELECT lang, term FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 10),
u AS (SELECT DISTINCT doc_id, lang, term FROM e SEMI JOIN top USING (lang, term))
SELECT x.lang, x.term AS a, y.term AS b, count(*)::BIGINT AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.lang = y.lang AND x.term < y.term GROUP BY 1, 2, 3""")
def cooc_matrix(spark, d):
    return bags.cooccurrence(table(spark, d, "documents"), _CONTENT(F.col("text")), ["lang"], 10)


@query("""WITH w AS (SELECT p_partkey, unnest(list_sort(list_distinct(string_split(p_name, ' ')))) AS x FROM part)
SELECT a.x AS a, b.x AS b, count(*)::BIGINT AS n FROM w a JOIN w b ON a.p_partkey = b.p_partkey AND a.x < b.x GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 15""")
def pair_counts(spark, d):
    return bags.pair_counts(table(spark, d, "part"), F.split("p_name", " "), 15)


@query(f"""WITH e AS (SELECT quality = 1 AS good, unnest({CONTENT}) AS term FROM documents JOIN labels USING (doc_id))
SELECT term, (count(*) FILTER (good))::BIGINT AS n FROM e GROUP BY 1 HAVING count(*) FILTER (good) > 0 AND count(*) FILTER (NOT good) = 0 ORDER BY n DESC, term LIMIT 15""")
def exclusive_terms(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return bags.exclusive_terms(joined, _CONTENT(F.col("text")), F.col("quality") == 1, 15)


@query(f"""WITH t AS (SELECT doc_id, {WS} AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n, floor(len(w) * 0.2)::INT AS a, floor(len(w) * 0.8)::INT AS b FROM t)
SELECT doc_id, a::BIGINT AS inicio, (b - a)::BIGINT AS meio, (n - b)::BIGINT AS fim, coalesce(w[b + 1], '') AS first_of_end FROM n""")
def thirds_volume(spark, d):
    rows = table(spark, d, "documents").select("doc_id", P.thirds(T.ws_tokens(F.col("text"))).alias("t"))
    return rows.select("doc_id", *[F.size(f"t.{k}").cast("long").alias(k) for k in ("inicio", "meio", "fim")], F.coalesce(F.get("t.fim", F.lit(0)), F.lit("")).alias("first_of_end"))


@query("""WITH p AS (SELECT doc_id, length(text) AS n, instr(text, '.') AS i FROM documents)
SELECT doc_id, CASE WHEN i = 0 THEN 'ausente' WHEN (i - 1) / n <= 0.2 THEN 'inicio' WHEN (i - 1) / n >= 0.8 THEN 'fim' ELSE 'meio' END AS posicao FROM p""")
def relative_position(spark, d):
    at = F.instr("text", ".")
    return table(spark, d, "documents").select("doc_id", F.when(at == 0, "ausente").otherwise(T.position_class(at - 1, F.char_length("text"))).alias("posicao"))


@query(f"WITH t AS (SELECT doc_id, {WS} AS w FROM documents) SELECT doc_id, coalesce(len(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2])) > 0, false) AS triple FROM t")
def triple_repeat(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(P.has_run(T.ws_tokens(F.col("text"))), F.lit(False)).alias("triple"))


@query(f"""WITH t AS (SELECT lang, {CONTENT} AS w FROM documents), g AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t), c AS (SELECT lang, term, count(*)::BIGINT AS n FROM g GROUP BY 1, 2)
SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::BIGINT AS rank FROM c QUALIFY rank <= 10""")
def ngrams(spark, d):
    return bags.top_counts(P.ngram_rows(table(spark, d, "documents"), _CONTENT(F.col("text")), ["lang"]), ["lang"], 10)


@query(f"SELECT doc_id, array_to_string(list_slice({WS}, 1, 15), ' ') AS hook, len(list_slice({WS}, 1, 15))::BIGINT AS n FROM documents")
def hook_tokens(spark, d):
    hook = T.hook(F.col("text"))
    return table(spark, d, "documents").select("doc_id", hook.alias("hook"), F.size(F.slice(T.ws_tokens(F.col("text")), 1, 15)).cast("long").alias("n"))


@query(f"""WITH t AS (SELECT doc_id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, lang, {CONTENT} AS w FROM documents)),
p AS (SELECT x.lang, least(x.w, y.w) AS a, greatest(x.w, y.w) AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i > x.i AND y.i <= x.i + 5 AND x.w <> y.w), c AS (SELECT lang, a, b, count(*)::BIGINT AS n FROM p GROUP BY ALL)
SELECT lang, a, b, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, a, b)::BIGINT AS rank FROM c QUALIFY rank <= 10""")
def window_pairs(spark, d):
    words = stored(spread(table(spark, d, "documents")).select("doc_id", "lang", _CONTENT(F.col("text")).alias("w")), "words")  # read several times
    return bags.top_counts_of_rows(P.window_pairs(words, F.col("w"), ["doc_id", "lang"]), "doc_id", ["lang"], 10, ("a", "b"), words.select("lang").distinct())
