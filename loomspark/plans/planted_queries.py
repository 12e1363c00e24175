"""Rules on texts that the tables hold too rarely: marks, calls, cues and emoji are planted into the words of ``documents``."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import bags, service, stats
from ..session import new_folder
from ..sources.readers import table
from ..sources.transactions import TableSet
from .profile_queries import _script
from .statistics_queries import TOKENS, WORD

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_NO = WORD.replace("[", "[^", 1)
_HEAD = f"w AS (SELECT doc_id, lang, source, array_to_string(list_slice({TOKENS}, 1, 8), ' ') AS head, array_to_string(list_slice({TOKENS}, 9, 16), ' ') AS tail FROM documents)"


def _words(spark, d):
    toks = T.tokens(F.col("text"))
    part = lambda a: F.array_join(F.slice(toks, a, 8), " ")
    return table(spark, d, "documents").select("doc_id", "lang", "source", part(1).alias("head"), part(9).alias("tail"))


def _case(n: int, texts: dict[int, str]):
    """A text by the remainder of doc_id, empty for the others: as a function that gives a column, and as SQL."""

    def column():
        out = F.lit("")
        for k, t in texts.items():
            out = F.when(F.col("doc_id") % n == k, t).otherwise(out)
        return out

    sql = ""
    for k, t in texts.items():
        sql += f" WHEN {k} THEN '" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return column, f"CASE doc_id % {n}{sql} ELSE '' END"


def _any(ws, low="low") -> str:
    return f"regexp_matches(' ' || {low} || ' ', '{_NO}(" + "|".join(ws).replace("'", "''") + f"){_NO}')"


def _in(ws) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"


_START, _END = _case(5, {0: "Why ", 1: "Stop ", 2: "7 ", 3: "Never "}), _case(7, {0: " mistake?", 1: " the best secret!", 2: " exposed", 3: "..."})


@query(f"""WITH {_HEAD}, t AS (SELECT doc_id, lower({_START[1]} || head || {_END[1]}) AS low FROM w), f AS (SELECT *, regexp_extract(low, '^{_NO}*((?:{WORD}|'')+)', 1) AS first FROM t)
SELECT doc_id, first IN {_in(W.QUESTION_WORDS)} OR contains(low, '?') AS question, first IN {_in(W.IMPERATIVE_WORDS)} AS imperative, {_any(W.PROBLEM_WORDS)} AS problem, {_any(W.PROMISE_WORDS)} AS promise,
{_any(W.POLEMIC_WORDS)} AS polemic, regexp_matches(low, '^\\s*[0-9]') AS number, regexp_matches(low, '[?!]') AS mark FROM f""")
def hook_flags(spark, d):
    rows = _words(spark, d).select("doc_id", F.concat(_START[0](), "head", _END[0]()).alias("t"))
    return rows.select("doc_id", T.hook_flags(F.col("t")).alias("f")).select("doc_id", "f.*")


_CALL = _case(6, {0: ", subscribe and like now", 1: " share", 2: ". Sign up, check out and save it", 3: " watch this today", 4: "; Buy, buy, BUY"})
_VERBS = "|".join(W.CTA_VERBS)
_WIDE = _VERBS.replace(" ", "  ")  # separators are doubled, so that two phrases do not share one


@query(f"""WITH {_HEAD}, t AS (SELECT doc_id, lower(head || {_CALL[1]} || ' ' || tail) AS low FROM w), f AS (SELECT *, len(list_distinct(regexp_extract_all(regexp_replace(' ' || low || ' ', '({_NO})', '\\1\\1', 'g'), '{_NO}({_WIDE}){_NO}', 1))) AS n, regexp_matches(low, '{"|".join(W.URGENCY_WORDS).replace("'", "''")}') AS urgent FROM t),
g AS (SELECT *, length(regexp_extract(low, '^(.*?(?:^|{_NO}))(?:{_VERBS})(?:{_NO}|$)', 1, 's')) / length(low) AS place FROM f)
SELECT doc_id, CASE WHEN n = 0 THEN 'ausente' WHEN n >= 3 OR n >= 2 AND urgent THEN 'direto' WHEN n = 2 OR urgent THEN 'moderado' ELSE 'suave' END AS intensidade,
round(CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, 0.2 * n + CASE WHEN urgent THEN 0.3 ELSE 0 END) END, 3)::DOUBLE AS score, CASE WHEN n = 0 THEN 'ausente' WHEN place <= 0.2 THEN 'inicio' WHEN place >= 0.8 THEN 'fim' ELSE 'meio' END AS posicao FROM g""")
def cta_rules(spark, d):
    rows = _words(spark, d).select("doc_id", F.concat("head", _CALL[0](), F.lit(" "), "tail").alias("t"))
    return rows.select("doc_id", T.cta(F.col("t")).alias("c")).select("doc_id", "c.*")


_CUES = _case(4, {0: " (laughs) [music] ♪ ", 1: " [applause] ", 2: " (laughs) (laughs) "})


@query(f"""WITH {_HEAD}, t AS (SELECT doc_id, '>> Ann Lee: [music] ' || head || {_CUES[1]} || CASE WHEN doc_id % 2 = 0 THEN ' >> Bob: ' ELSE '' END || tail AS t FROM w),
c AS (SELECT *, regexp_extract_all(t, '\\[.*?\\]|\\(.*?\\)|♪') AS c FROM t), k AS (SELECT *, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ' ') AS pistas FROM c)
SELECT doc_id, pistas, list_sort(list_transform(range(1, len(c) + 1), lambda i: {{'n': -len(list_filter(c, lambda y: y = c[i])), 'i': i, 'c': c[i]}}))[1].c AS dominante,
trim(regexp_replace(replace(regexp_replace(regexp_replace(t, '\\[.*?\\]|\\(.*?\\)|♪', ' ', 'g'), '>>\\s*(?:{WORD}|\\s)+:', ' ', 'g'), '>>', ' '), '\\s+', ' ', 'g')) AS limpo, (length(t) - length(replace(t, '>>', ''))) / 2 >= 2 AS dialogo,
CASE WHEN regexp_matches(lower(pistas), 'music|song|♪') THEN 'musica' WHEN contains(lower(pistas), 'laugh') THEN 'riso' WHEN regexp_matches(lower(pistas), 'applau|clap|cheer') THEN 'aplauso' ELSE 'efeito' END AS audio FROM k""")
def transcript_cleaning(spark, d):
    rows = _words(spark, d).select("doc_id", F.concat(F.lit(">> Ann Lee: [music] "), "head", _CUES[0](), F.when(F.col("doc_id") % 2 == 0, " >> Bob: ").otherwise(""), "tail").alias("t"))
    t = F.col("t")
    cues = F.array_join(T.audio_cues(t), " ")
    return rows.select("doc_id", cues.alias("pistas"), T.dominant_cue(t).alias("dominante"), T.clean_transcript(t).alias("limpo"), T.is_dialogue(t).alias("dialogo"), T.audio_category(cues).alias("audio"))


_E1, _E2, _E3 = _case(4, {0: "🔥 ", 1: "😂😍 "}), _case(3, {0: " 😂👍 ", 1: " 👍👍⭐ "}), _case(5, {0: " 🎉🔥", 1: " 👏"})
#: Blocks of the emoji code points; their names come from the Unicode table of the running Python.
_BLOCKS = ((0x1F300, 0x1FAFF), (0x2600, 0x27BF))
_PLANTED = "🔥😂😍👍⭐🎉👏"
_FACES = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_EMOJI_TEXT = f"t AS (SELECT doc_id, lang, {_E1[1]} || head || {_E2[1]} || tail || {_E3[1]} AS t FROM w)"


def emoji_names(spark):
    """(emoji, nome) of every named code point of the emoji blocks, about 2,000 rows by rule, so it can be broadcast."""
    rows = [(chr(c), unicodedata.name(chr(c)).lower()) for a, b in _BLOCKS for c in range(a, b + 1) if unicodedata.name(chr(c), "")]
    return spark.createDataFrame(rows, "emoji string, nome string")


def _with_emoji(spark, d):
    return _words(spark, d).select("doc_id", "lang", F.concat(_E1[0](), "head", _E2[0](), "tail", _E3[0]()).alias("t"))


@query(f"""WITH {_HEAD}, {_EMOJI_TEXT}, c AS (SELECT substring(t, i::INT, 1) AS emoji, (i - 1) / length(t) AS place FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM t))
SELECT emoji, CASE WHEN place <= 0.2 THEN 'inicio' WHEN place >= 0.8 THEN 'fim' ELSE 'meio' END AS posicao, count(*)::BIGINT AS n FROM c WHERE regexp_matches(emoji, '^{_FACES}$') GROUP BY ALL""")
def emoji_places(spark, d):
    rows = _with_emoji(spark, d).select(F.explode(T.emoji_positions(F.col("t"))).alias("e"))
    return rows.groupBy("e.emoji", "e.posicao").agg(F.count("*").alias("n"))


def _category(name: str) -> str:
    return next((c for part, c in W.EMOJI_CATEGORIES.items() if part in name), "outro")


_NAMED = ", ".join(f"('{e}', '{unicodedata.name(e).lower()}', '{_category(unicodedata.name(e).lower())}')" for e in _PLANTED)


@query(f"""WITH {_HEAD}, {_EMOJI_TEXT}, c AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_FACES}')) AS emoji FROM t)
SELECT emoji, nome, categoria, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS textos, round(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 3) AS pct FROM c JOIN (VALUES {_NAMED}) AS v(emoji, nome, categoria) USING (emoji) GROUP BY 1, 2, 3""")
def emoji_categories(spark, d):
    rows = _with_emoji(spark, d)
    counts = rows.select("doc_id", F.explode(T.emojis(F.col("t"))).alias("emoji")).groupBy("emoji", "doc_id").agg(F.count("*").alias("n")).groupBy("emoji").agg(F.sum("n").alias("n"), F.count("*").alias("textos"))
    named = counts.join(F.broadcast(emoji_names(spark)), "emoji", "left").crossJoin(F.broadcast(bags.row_count(rows)))
    return named.select("emoji", "nome", T.emoji_category(F.col("nome")).alias("categoria"), "n", "textos", F.round(100.0 * F.col("textos") / F.col("_rows"), 3).alias("pct"))


@query(f"""WITH {_HEAD}, {_EMOJI_TEXT}, c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, '{_FACES}'))) AS e FROM t) SELECT a.e AS a, b.e AS b, count(*)::BIGINT AS n FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.e < b.e GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 10""")
def emoji_pairs(spark, d):
    return bags.pair_counts(_with_emoji(spark, d), T.emojis(F.col("t")), 10)


@query(f"""WITH {_HEAD}, {_EMOJI_TEXT}, c AS (SELECT doc_id % 4 = 1 AS side, unnest(regexp_extract_all(t, '{_FACES}')) AS e FROM t WHERE doc_id % 4 < 2) SELECT e AS term, (count(*) FILTER (side))::BIGINT AS n FROM c GROUP BY 1 HAVING count(*) FILTER (side) > 0 AND count(*) FILTER (NOT side) = 0 ORDER BY n DESC, term LIMIT 5""")
def emoji_exclusive(spark, d):
    return bags.exclusive_terms(_with_emoji(spark, d).where("doc_id % 4 < 2"), T.emojis(F.col("t")), F.col("doc_id") % 4 == 1, 5)


_TITLE = f"t AS (SELECT doc_id, head || ' #now @me ' || {_E1[1]} || {_E2[1]} AS t, tail || ' ann_123 #x' || {_E3[1]} AS c FROM w)"
_BARE = "trim(regexp_replace(regexp_replace({c}, '#\\S+|@\\S+', '', 'g'), '{e}', '', 'g'))"


@query(f"""WITH {_HEAD}, {_TITLE} SELECT doc_id, {_BARE.format(c="t", e=T.EMOJI)} AS titulo, trim(regexp_replace(regexp_replace({_BARE.format(c="c", e=T.EMOJI)}, '\\S*[0-9_]\\S*', '', 'g'), '\\s+', ' ', 'g')) AS capa,
array_to_string(list_sort(list_distinct(regexp_extract_all(t, '{_FACES}'))), '') AS emojis FROM t""")
def title_cleaning(spark, d):
    rows = _words(spark, d).select("doc_id", F.concat("head", F.lit(" #now @me "), _E1[0](), _E2[0]()).alias("t"), F.concat("tail", F.lit(" ann_123 #x"), _E3[0]()).alias("c"))
    return rows.select("doc_id", T.clean_title(F.col("t")).alias("titulo"), T.clean_cover(F.col("c")).alias("capa"), T.emoji_set(F.col("t")).alias("emojis"))


_LINES = _case(4, {0: "\nhttp://a.b/c", 1: "\n\nhttps://x.y\nmore words\n", 2: "\nhttp://a.b\nhttp://c.d\nhttp://e.f"})


@query(f"""WITH {_HEAD}, t AS (SELECT doc_id, list_filter(string_split(head || {_LINES[1]}, chr(10)), lambda x: trim(x) <> '') AS x FROM w), s AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN 0 ELSE round(len(list_filter(x, lambda y: regexp_matches(y, 'https?://\\S+'))) / len(x), 3) END AS share FROM t)
SELECT doc_id, share::DOUBLE AS share, share >= 0.5 AS farm FROM s""")
def link_farms(spark, d):
    share = T.link_line_share(F.concat("head", _LINES[0]()))
    return _words(spark, d).select("doc_id", share.alias("share")).withColumn("farm", F.col("share") >= 0.5)


_SCENE = _case(4, {0: "two Women at work", 1: "a persons dog", 2: "mankind and a lady"})
_PEOPLE = "|".join(W.PERSON_WORDS)


@query(f"""WITH {_HEAD}, t AS (SELECT *, head || ' http://a.b/' || doc_id || ' and @ann_' || doc_id || '!' AS t, {_SCENE[1]} AS s, source || '_' || lang AS k, head || '文字 x' AS l FROM w)
SELECT doc_id, left(regexp_replace(regexp_replace(t, 'http\\S+', 'http', 'g'), '@{WORD}+', '@user', 'g'), 512) AS limpo, regexp_matches(' ' || lower(s) || ' ', '{_NO}({_PEOPLE})s?{_NO}') AS pessoa,
array_to_string(list_transform(string_split(replace(k, '_', ' '), ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ') AS rotulo, CASE WHEN length(q) > 35 THEN left(q, 35) || '...' ELSE q END AS curto
FROM (SELECT *, trim(regexp_replace(l, '[^\\p{{Latin}}\\p{{N}}\\p{{P}}\\s]', '', 'g')) AS q FROM t)""")
def label_cleaning(spark, d):
    number = F.col("doc_id").cast("string")
    t = F.concat("head", F.lit(" http://a.b/"), number, F.lit(" and @ann_"), number, F.lit("!"))
    rows = _words(spark, d).select("doc_id", t.alias("t"), _SCENE[0]().alias("s"), F.concat_ws("_", "source", "lang").alias("k"), F.concat("head", F.lit("文字 x")).alias("l"))
    return rows.select("doc_id", T.sentiment_input(F.col("t")).alias("limpo"), T.has_person(F.col("s")).alias("pessoa"), T.title_case(F.col("k")).alias("rotulo"), T.short_label(F.col("l")).alias("curto"))


@query(f"""WITH p AS (SELECT doc_id, {TOKENS} AS x FROM documents), q AS (SELECT doc_id, x[1] AS a, x[2] AS b, x[3] AS c FROM p WHERE len(x) >= 3)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN a || '|' || b || ', ' || c WHEN 1 THEN a || '|' || b || '|it''s ' || c ELSE a || '|' || b || '|' || c END AS itens, CASE WHEN doc_id % 2 = 0 THEN '{{"x": ' || doc_id || '}}' ELSE a END AS json FROM q""")
def literal_lists(spark, d):
    toks = T.tokens(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", toks.alias("x")).where(F.size("x") >= 3).select("doc_id", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate("abc")])
    text = (
        F.when(F.col("doc_id") % 3 == 0, F.format_string("['%s', \"%s, %s\"]", "a", "b", "c")).when(F.col("doc_id") % 3 == 1, F.format_string("[\"%s\", '%s', 'it\\'s %s']", "a", "b", "c"))
        .otherwise(F.format_string(" %s , %s,%s,", "a", "b", "c"))
    )
    fenced = F.when(F.col("doc_id") % 2 == 0, F.format_string("```json\n{\"x\": %d}\n```", "doc_id")).otherwise(F.col("a"))
    return rows.select("doc_id", F.array_join(T.list_literal(text), "|").alias("itens"), T.unfenced(fenced).alias("json"))


@query("""WITH j AS (SELECT quality, n_chars FROM documents LEFT JOIN labels USING (doc_id)), q AS (SELECT quality, quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM j GROUP BY 1)
SELECT j.quality::BIGINT AS quality, count(*)::BIGINT AS n, round(avg(n_chars), 3) AS mean, round(median(n_chars), 3) AS median, round(any_value(a), 3) AS q1, round(any_value(b), 3) AS q3,
(count(*) FILTER (n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)))::BIGINT AS outliers FROM j JOIN q ON j.quality IS NOT DISTINCT FROM q.quality GROUP BY 1""")
def null_group_statistics(spark, d):
    """Documents without a label are a group of their own."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    rows = table(spark, d, "documents").join(labels, "doc_id", "left").select("quality", "n_chars")
    out = stats.with_groups(stats.describe(rows, "n_chars", ["quality"]), stats.tukey(rows, "n_chars", ["quality"]).select("quality", "outliers"), ["quality"])
    return out.select("quality", "n", *[F.round(c, 3).alias(c) for c in ("mean", "median", "q1", "q3")], "outliers")


_BATCH = "b AS (SELECT c_custkey AS seq, c_name AS name, lower(c_name) || '@x.y' AS email, c_mktsegment AS niche FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000000, c_name, '  ' || upper(c_name) || '@X.Y', 'late' FROM customer WHERE c_custkey % 6 = 3)"


@query(f"""WITH {_BATCH}, u AS (SELECT DISTINCT lower(c_name) || '@x.y' AS email FROM customer WHERE c_custkey % 2 = 0), k AS (SELECT *, lower(trim(email)) AS address FROM b),
s AS (SELECT *, CASE WHEN address IN (SELECT email FROM u) THEN 'conflict' WHEN row_number() OVER (PARTITION BY address ORDER BY seq) > 1 THEN 'duplicate' ELSE 'registered' END AS status FROM k)
SELECT status, count(*)::BIGINT AS n, (SELECT count(*) FROM u) + (SELECT count(*) FROM s WHERE status = 'registered') AS users, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 6 = 3) AS niches, (SELECT count(*) FROM s WHERE status = 'registered') AS links FROM s GROUP BY 1""")
def register_users(spark, d):
    """Customers with even keys are users already; the others register in one batch, some of them twice."""
    c = table(spark, d, "customer")
    email = F.concat(F.lower("c_name"), F.lit("@x.y"))
    store = TableSet(spark, new_folder(spark, "users"))
    old = c.where("c_custkey % 2 = 0")
    none = spark.createDataFrame([], "user_id string, niche_id string")
    store.commit(0, append={"users": old.select(F.md5(email).alias("id"), F.col("c_name").alias("name"), email.alias("email")), "niches": old.select(F.md5(F.lower("c_mktsegment")).alias("id"), F.col("c_mktsegment").alias("name")).distinct(), "user_niches": none})
    batch = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("seq"), F.col("c_name").alias("name"), email.alias("email"), F.col("c_mktsegment").alias("niche"))
    twice = c.where("c_custkey % 6 = 3").select((F.col("c_custkey") + F.lit(1_000_000_000)).cast("long").alias("seq"), F.col("c_name").alias("name"), F.concat(F.lit("  "), F.upper("c_name"), F.lit("@X.Y")).alias("email"), F.lit("late").alias("niche"))
    found = service.register(store, batch.unionByName(twice), [F.asc("seq")])
    size = lambda name: store.read(name).agg(F.count("*").alias(name))
    out = found.groupBy("status").agg(F.count("*").alias("n"))
    for name in ("users", "niches", "user_niches"):
        out = out.crossJoin(F.broadcast(size(name)))
    return out.withColumnRenamed("user_niches", "links")


@query("SELECT o_orderkey, o_custkey % 4 = o_orderkey % 4 AS accepted FROM orders WHERE o_orderkey % 8 < 4")
def create_generations(spark, d):
    """Orders as requests: a customer has the niche of its key's remainder, a request is for that of the order's key."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    store = TableSet(spark, new_folder(spark, "generations"))
    links = o.select(F.col("o_custkey").cast("string").alias("user_id"), (F.col("o_custkey") % 4).cast("string").alias("niche_id")).distinct()
    requests = o.where("o_orderkey % 8 < 4").select(F.col("o_custkey").cast("string").alias("user_id"), (F.col("o_orderkey") % 4).cast("string").alias("niche_id"), "o_orderkey")
    store.commit(0, append={"user_niches": links, "generations": requests.limit(0), "users": c.select("c_custkey")})
    return service.create_generations(store, requests).select("o_orderkey", "accepted")


_TAGS = _case(4, {0: " #now #tags2 @ann", 1: " @bob @eve 🔥", 2: " #só"})


@query(f"""WITH {_HEAD}, t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE tail || {_TAGS[1]} END AS d, head || {_E1[1]} AS t, len(list_slice(string_split(head || ' ' || tail, ' '), 1, doc_id % 20)) AS k FROM w),
r AS (SELECT doc_id, CASE WHEN trim(d) = '' THEN 0 ELSE 1 END + least(3.0, k / 5.0) + len(regexp_extract_all(t || ' ' || d, '#{WORD}+')) + len(regexp_extract_all(t || ' ' || d, '@{WORD}+')) + len(regexp_extract_all(t || ' ' || d, '{_FACES}')) AS raw FROM t)
SELECT doc_id, round(raw, 4)::DOUBLE AS pontos, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 4)::DOUBLE AS completude FROM r""")
def seo_completeness(spark, d):
    described = F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.concat("tail", _TAGS[0]()))
    terms = F.slice(F.split(F.concat_ws(" ", "head", "tail"), " "), F.lit(1), (F.col("doc_id") % 20).cast("int"))
    rows = _words(spark, d).select("doc_id", described.alias("d"), F.concat("head", _E1[0]()).alias("t"), terms.alias("k"))
    raw = T.seo_completeness(F.col("d"), F.col("k"), F.concat_ws(" ", "t", "d"))
    scored = rows.select("doc_id", raw.alias("pontos"), raw.alias("completude"))
    return stats.min_max(scored, ["completude"]).select("doc_id", F.round("pontos", 4).alias("pontos"), F.round("completude", 4).alias("completude"))


_SHOUT = _case(3, {0: "BIG NEWS ", 1: "A I OK Ok "})


@query(f"""WITH {_HEAD}, t AS (SELECT doc_id, regexp_extract_all({_SHOUT[1]} || head || ' 123 X9YZ', '[A-Za-zÀ-ÖØ-öø-ÿ]+') AS r FROM w)
SELECT doc_id, round(len(list_filter(r, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) / len(r), 3) AS caps FROM t""")
def letter_run_caps(spark, d):
    return _words(spark, d).select("doc_id", T.letter_run_caps(F.concat(_SHOUT[0](), "head", F.lit(" 123 X9YZ"))).alias("caps"))


@query(f"""WITH {_HEAD} SELECT doc_id, trim(regexp_replace(regexp_replace(lower(head || ' don''t stop -- ' || tail || '!? (e-mail)'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s''-]', ' ', 'g'), '\\s+', ' ', 'g')) AS limpo FROM w""")
def plain_with_kept_marks(spark, d):
    return _words(spark, d).select("doc_id", T.plain(F.concat("head", F.lit(" don't stop -- "), "tail", F.lit("!? (e-mail)")), keep="'-").alias("limpo"))


_SCRIPTED = "text || CASE WHEN doc_id % 5 = 0 THEN repeat('слово ', 400) WHEN doc_id % 7 = 0 THEN repeat('λόγος ', 400) ELSE '' END"


@query(f"""WITH s AS (SELECT {_script("text")} AS texto, {_script("source")} AS origem, {_script("lang")} AS idioma FROM (SELECT {_SCRIPTED} AS text, source, lang FROM documents)), l AS (SELECT 'texto' AS coluna, texto AS script FROM s UNION ALL SELECT 'origem', origem FROM s UNION ALL SELECT 'idioma', idioma FROM s)
SELECT script, (count(*) FILTER (coluna = 'texto'))::BIGINT AS texto, (count(*) FILTER (coluna = 'origem'))::BIGINT AS origem, (count(*) FILTER (coluna = 'idioma'))::BIGINT AS idioma FROM l GROUP BY 1 ORDER BY count(*) DESC, script LIMIT 8""")
def script_matrix(spark, d):
    """Which script rules which column: counts of the eight commonest scripts by column."""
    docs = table(spark, d, "documents")
    more = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("слово "), F.lit(400))).when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("λόγος "), F.lit(400))).otherwise("")
    found = docs.select(*[T.dominant_script(c).alias(n) for n, c in (("texto", F.concat("text", more)), ("origem", F.col("source")), ("idioma", F.col("lang")))])
    wide = stats.pivot_counts(found.unpivot([], ["texto", "origem", "idioma"], "coluna", "script"), "script", "coluna", ["texto", "origem", "idioma"])
    return wide.orderBy(F.desc(F.col("texto") + F.col("origem") + F.col("idioma")), "script").limit(8)
