"""Filters, projections, joins and service statistics over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import filters, service, stats, vectors
from ..sources.readers import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT event_type, count(*)::BIGINT AS n, count(try_cast(json_extract_string(props, '$.page') AS DOUBLE))::BIGINT AS numeric_n FROM events GROUP BY 1")
def coerce_numeric(spark, d):
    page = F.get_json_object("props", "$.page")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(filters.to_number(page)).alias("numeric_n"))


@query("SELECT doc_id, CASE WHEN quality::VARCHAR IN ('1', 'true') THEN true WHEN quality::VARCHAR IN ('0', 'false') THEN false END AS good FROM labels")
def coerce_bool(spark, d):
    return table(spark, d, "labels").select("doc_id", filters.to_bool(F.col("quality")).alias("good"))


@query("SELECT event_id FROM events WHERE event_type IS NOT NULL AND trim(event_type) NOT IN ('', '[]', 'nan', 'None', 'none', 'NaN')")
def sentinel_filter(spark, d):
    return filters.without_sentinels(table(spark, d, "events"), "event_type").select("event_id")


@query("""WITH s AS (SELECT source, max(length(text) BETWEEN 400 AND 900) AS ok FROM documents GROUP BY 1)
SELECT doc_id FROM documents JOIN s USING (source) WHERE length(text) BETWEEN 400 AND 900 OR NOT ok""")
def length_band(spark, d):
    return filters.length_band(table(spark, d, "documents"), "text", 400, 900, "source").select("doc_id")


@query("""WITH t AS (SELECT doc_id, lang, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM documents),
c AS (SELECT lang, greatest(5.0, median(n) - coalesce(stddev_samp(n), 0)) AS cut FROM t GROUP BY 1)
SELECT doc_id, n FROM t JOIN c USING (lang) WHERE n >= cut AND doc_id NOT IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{4,}'))""")
def dynamic_threshold(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.size(T.ws_tokens(F.col("text"))).cast("long").alias("n"), F.col("text").rlike("[0-9]{4,}").alias("long_number"))
    return filters.dynamic_minimum(docs, F.col("n"), "lang", 5).where("not long_number").select("doc_id", "n")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 3")
def min_tokens(spark, d):
    return table(spark, d, "documents").where(F.size(T.ws_tokens(F.col("text"))) >= 3).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def optional_predicate(spark, d):
    return filters.where_given(table(spark, d, "orders"), o_orderstatus="O", o_orderpriority=None).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE (contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), 'auto')) AND c_nationkey = 3")
def substring_search(spark, d):
    rows = filters.where_given(table(spark, d, "customer").where(filters.contains_any(["c_name", "c_mktsegment"], "00012") | filters.contains_any(["c_mktsegment"], "AUTO")), c_nationkey=3)
    return rows.select("c_custkey", "c_name")


@query("""SELECT lang, count(*)::BIGINT AS n, (count(*) FILTER (regexp_matches(text, '[0-9]')))::BIGINT AS n_digit, round(100.0 * count(*) FILTER (regexp_matches(text, '[0-9]')) / count(*), 4) AS pct_digit,
(count(*) FILTER (regexp_matches(text, '[?!]')))::BIGINT AS n_mark, round(100.0 * count(*) FILTER (regexp_matches(text, '[?!]')) / count(*), 4) AS pct_mark,
(count(*) FILTER (regexp_matches(text, '@[\\p{L}\\p{M}\\p{N}_]')))::BIGINT AS n_mention, round(100.0 * count(*) FILTER (regexp_matches(text, '@[\\p{L}\\p{M}\\p{N}_]')) / count(*), 4) AS pct_mention,
(count(*) FILTER (regexp_matches(text, 'https?://\\S+')))::BIGINT AS n_url, round(100.0 * count(*) FILTER (regexp_matches(text, 'https?://\\S+')) / count(*), 4) AS pct_url FROM documents GROUP BY 1""")
def construction_profile(spark, d):
    t = F.col("text")
    marks = {"digit": t.rlike("[0-9]"), "mark": t.rlike("[?!]"), "mention": t.rlike(r"(?U)@\w"), "url": T.has_link(t)}
    return stats.shares(table(spark, d, "documents"), marks, ["lang"])


@query("""SELECT o_orderpriority, count(*)::BIGINT AS n, (count(*) FILTER (o_totalprice >= 200000))::BIGINT AS n_high, round(100.0 * count(*) FILTER (o_totalprice >= 200000) / count(*), 4) AS pct_high,
(count(*) FILTER (o_totalprice < 50000))::BIGINT AS n_low, round(100.0 * count(*) FILTER (o_totalprice < 50000) / count(*), 4) AS pct_low FROM orders GROUP BY 1""")
def fixed_bands(spark, d):
    return stats.shares(table(spark, d, "orders"), {"high": F.col("o_totalprice") >= 200000, "low": F.col("o_totalprice") < 50000}, ["o_orderpriority"])


@query("""WITH c AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.75) AS cut FROM orders GROUP BY 1)
SELECT o_orderkey FROM orders JOIN c USING (o_orderpriority) WHERE o_totalprice >= cut""")
def quantile_filter(spark, d):
    return filters.above_quantile(table(spark, d, "orders"), "o_totalprice", 0.75, ["o_orderpriority"]).select("o_orderkey")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_existing(spark, d):
    return filters.select_existing(table(spark, d, "customer"), ["c_custkey", "c_name", "c_missing", "c_mktsegment"])[0]


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'exposure' WHEN 'purchase' THEN 'conversion' WHEN 'signup' THEN 'conversion' ELSE 'Desconhecida' END AS category FROM events")
def dictionary_map(spark, d):
    return table(spark, d, "events").select("event_id", filters.mapped(F.col("event_type"), W.CATEGORIES, "Desconhecida").alias("category"))


@query("SELECT part.p_partkey, split_part(p_name, ' ', 1) AS first_word, len(string_split(p_name, ' '))::BIGINT AS n_words FROM part")
def struct_split(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.struct(F.element_at(words, 1).alias("first_word"), F.size(words).cast("long").alias("n_words")).alias("s")).select("p_partkey", "s.*")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inner_nn(spark, d):
    nation = table(spark, d, "nation")
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("""SELECT n_name, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def inner_three_way(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT doc_id, coalesce(quality::VARCHAR, 'Unknown') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_lookup_default(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return service.lookup(table(spark, d, "documents").select("doc_id"), labels, ["doc_id"], "quality", "Unknown")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_zero_fill(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return service.zero_filled(table(spark, d, "customer").select("c_custkey"), counts, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark, d):
    o = table(spark, d, "orders")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def composite_lookup(spark, d):
    return table(spark, d, "orders").where((F.col("o_custkey") == 7) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
SELECT vec_id, c.label AS centroid_label, round(list_cosine_similarity(embedding::DOUBLE[], c), 4) + 0.0 AS cos FROM embeddings CROSS JOIN c""")
def cosine_cross(spark, d):
    e = table(spark, d, "embeddings")
    centres = vectors.centroids(e, "embedding", ["label"]).withColumnRenamed("label", "centroid_label")
    return vectors.with_each(e.select("vec_id", "embedding"), centres, ("centroid_label", "centroid")).select("vec_id", "centroid_label", (F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 4) + 0.0).alias("cos"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS mes, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def niche_stats(spark, d):
    return stats.month_counts(table(spark, d, "orders"), "o_orderdate")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY ROLLUP (c_mktsegment)")
def user_stats(spark, d):
    return service.totals_and_groups(table(spark, d, "customer"), "c_mktsegment")


@query("SELECT n_name, count(o_orderkey)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def generation_stats(spark, d):
    counts = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return service.lookup(counts, table(spark, d, "nation"), ["n_nationkey"], "n_name", "Unknown").select("n_name", "n").orderBy(F.desc("n"))


_FEEDBACK = """SELECT l_orderkey, CASE l_linestatus WHEN 'O' THEN 'STRUCTURE' ELSE 'SCRIPT' END AS type, l_returnflag = 'N' AS is_useful FROM lineitem"""
_SIDES = ", ".join(
    f"(count(*) FILTER (type = '{k}'))::BIGINT AS {k.lower()}_count, (count(*) FILTER (type = '{k}' AND is_useful))::BIGINT AS {k.lower()}_useful, "
    f"coalesce(round(100.0 * count(*) FILTER (type = '{k}' AND is_useful) / nullif(count(*) FILTER (type = '{k}'), 0)), 0)::BIGINT AS {k.lower()}_percent"
    for k in ("STRUCTURE", "SCRIPT")
)


def _feedback(spark, d):
    kind = F.when(F.col("l_linestatus") == "O", "STRUCTURE").otherwise("SCRIPT")
    return table(spark, d, "lineitem").select("l_orderkey", kind.alias("type"), (F.col("l_returnflag") == "N").alias("is_useful"))


@query(f"WITH f AS ({_FEEDBACK}) SELECT {_SIDES} FROM f")
def feedback_stats(spark, d):
    return service.feedback_stats(_feedback(spark, d))


@query(f"WITH f AS ({_FEEDBACK}) SELECT o_orderpriority, {_SIDES} FROM f JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def feedback_by_niche(spark, d):
    return service.feedback_stats(_feedback(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), ["o_orderpriority"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 5")
def recent_five(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(5)


@query("""SELECT c_mktsegment, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER ()) AS pct, round(count(*) / max(count(*)) OVER (), 4) AS vs_max FROM customer GROUP BY 1""")
def share_of_total(spark, d):
    return stats.with_share(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1, 2")
def latest_upsert(spark, d):
    return service.latest(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.desc("event_id")])


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING'""")
def user_directory(spark, d):
    rows = filters.where_given(table(spark, d, "customer"), c_mktsegment="BUILDING").where(filters.contains_any(["c_name"], "1"))
    return rows.select("c_custkey", "c_name", "c_mktsegment").orderBy(F.lower("c_name"))


@query("""SELECT conv_id, count(*)::BIGINT AS n_turns, (count(*) FILTER (role = 'user'))::BIGINT AS n_user, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY 1""")
def dialogue_turns(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars"))


@query("SELECT doc_id, (text IS NOT NULL)::BIGINT + (lang IS NOT NULL)::BIGINT + (source IS NOT NULL)::BIGINT + (n_chars IS NOT NULL)::BIGINT AS n_present FROM documents")
def field_presence(spark, d):
    present = F.size(F.filter(F.array(*[F.col(c).isNotNull() for c in ("text", "lang", "source", "n_chars")]), lambda x: x))
    return table(spark, d, "documents").select("doc_id", present.cast("long").alias("n_present"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'")
def expired_rows(spark, d):
    return filters.expired(table(spark, d, "orders"), F.lit("1995-01-01").cast("timestamp"), "o_orderdate").select("o_custkey").distinct()


_NICHES = """m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT 'n' || label AS niche, label, list(m ORDER BY i) AS c FROM m GROUP BY ALL)"""


@query(f"""WITH {_NICHES}, k AS (SELECT * FROM c WHERE label % 3 <> 0), near AS (SELECT a.niche, b.niche AS nearest FROM c a JOIN k b ON a.niche <> b.niche QUALIFY row_number() OVER (PARTITION BY a.niche ORDER BY round(list_cosine_similarity(a.c, b.c), 10) DESC, b.niche DESC) = 1)
SELECT c.niche, coalesce(k.niche, nearest) AS resolved, k.niche IS NULL AND nearest IS NOT NULL AS fallback_used FROM c LEFT JOIN k USING (niche) LEFT JOIN near USING (niche)""")
def infer_niche(spark, d):
    """Niches whose pattern is known are answered directly, the others by the known niche with the nearest mean vector."""
    e = table(spark, d, "embeddings")
    c = vectors.centroids(e, "embedding", ["label"]).withColumn("niche", F.concat(F.lit("n"), F.col("label").cast("string")))
    known = c.where("label % 3 <> 0").select(F.col("niche").alias("nicho"), F.col("centroid").alias("_c"))
    pairs = c.join(F.broadcast(known), F.col("niche") != F.col("nicho"))  # a row for each two labels
    near = pairs.groupBy("niche").agg(F.max_by("nicho", F.struct(F.round(vectors.cosine(F.col("centroid"), F.col("_c")), 10), "nicho")).alias("nearest"))
    return service.infer(c.select("niche"), known, near).select("niche", "resolved", "fallback_used")
