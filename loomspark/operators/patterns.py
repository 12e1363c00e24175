"""Pattern documents: one nested row per niche.

The features of all rows are worked out once and stored; scalars, term bags, examples and meanings are
aggregates over columns of that table, so texts are parsed once however many topics a document has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import positional as P
from ..functions import text as T
from ..session import new_folder, passing, spread, stored
from . import bags as term_bags
from . import density, terms, vectors
from .embedding import Encoder, HashedGrams, remembered, with_vectors
from .stats import median_of, mode, percentiles, top_rows, with_groups

#: Columns of a video besides niche, id and text. Those that a table lacks are null.
INPUTS = {
    "titulo": "string", "descricao": "string", "palavras_chave": "array<string>", "texto_capa": "string", "cena": "string", "dia": "string", "janela": "string",
    "duracao": "double", "faixa": "string", "taxa_conversao": "double", "taxa_discussao": "double", "formato": "string",
}
#: Bags of the document: how many of the commonest terms each one keeps.
BAGS = {
    "vocabulario": 30, "moldes": 10, "pares": 10, "inicio": 10, "meio": 10, "fim": 10, "titulo": 20, "titulo_emojis": 5, "descricao": 20, "descricao_emojis": 5,
    "hashtags": 15, "shorttail": 15, "midtail": 15, "longtail": 15, "capa": 20, "capa_emojis": 5, "cena": 15, "pistas": 5, "slots": 3, "cta": 10,
}
ARC = ("inicio", "meio", "fim")


def features(df: DataFrame, niche: str = "nicho", text: str = "texto") -> DataFrame:
    """Row features that the aggregates need. Tokens come first, so each text is parsed once for a scan."""
    rows = df.withColumns({c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in df.columns})
    t = F.col(text)
    rows = rows.withColumn("titulo", F.coalesce("titulo", T.first_line(t))).withColumn("descricao", F.coalesce("descricao", t))
    rows = rows.withColumns({"_toks": T.ws_tokens(t), "_content": T.content_tokens(t), "_chave": T.keyword_tails(F.coalesce("palavras_chave", F.array().cast("array<string>")))})
    rows = rows.withColumn("_partes", P.thirds(F.col("_content")))
    # Without descriptions of their own the text is taken for them, and its tokens are theirs.
    own = [T.content_tokens(F.col("descricao")).alias("_descricao")] if "descricao" in df.columns else []
    tagged = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("a"), F.lit("").alias("b"), F.lit(True).alias("keep")))
    pair = lambda kind, items, a, b: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x[a].alias("a"), x[b].alias("b"), F.lit(True).alias("keep")))
    lists = {
        "titulo": tagged("titulo", T.content_tokens(T.clean_title(F.col("titulo")))), "titulo_emojis": pair("titulo_emojis", T.emoji_positions(F.coalesce("titulo", F.lit(""))), "emoji", "posicao"),
        "descricao": tagged("descricao", T.content_tokens(T.first_line(F.col("descricao")))), "descricao_emojis": tagged("descricao_emojis", T.emojis(F.col("descricao"))),
        "hashtags": tagged("hashtags", T.hashtags(F.col("descricao"))), **{k: tagged(k, F.col(f"_chave.{k}")) for k in ("shorttail", "midtail", "longtail")},
        "capa": tagged("capa", T.content_tokens(T.clean_cover(F.col("texto_capa")))), "capa_emojis": tagged("capa_emojis", T.emojis(F.col("texto_capa"))), "cena": tagged("cena", T.content_tokens(F.col("cena"))),
        "pistas": tagged("pistas", T.tag_cues(t)), "cta": tagged("cta", T.cta_terms(t)),
        "slots": F.when(F.col("dia").isNotNull() & F.col("janela").isNotNull(), pair("slots", F.array(F.struct("dia", "janela")), "dia", "janela")).otherwise(F.array()),
    }
    tone = lambda part: T.sentiment(T.polarity(F.array_join(f"_partes.{part}", " "))).alias(part)
    return rows.select(
        *df.columns, *[c for c in INPUTS if c not in df.columns], "_content", *own, "_chave",
        F.size("_toks").alias("n_words"), T.trimmed_length(F.col("titulo")).alias("titulo_comprimento"), T.caps_ratio(F.col("titulo")).alias("titulo_caps"),
        T.impact_score(F.col("titulo")).alias("titulo_impacto"), T.opening_formula(F.col("titulo")).alias("titulo_formula"), T.sentiment(T.polarity(F.col("titulo"))).alias("titulo_tom"),
        T.hook(t).alias("gancho"), T.opening_formula(t).alias("gancho_formula"), T.sentence_rhythm(t).alias("ritmo"), T.cta(F.col("descricao")).alias("cta"), T.is_dialogue(t).alias("dialogo"),
        T.repeats_word(t).alias("repeticao"), P.max_repeat(F.col("_content")).alias("maior_repeticao"), T.has_link(F.col("descricao")).alias("tem_link"), T.dominant_cue(t).alias("audio"),
        (F.size(T.tag_cues(t)) > 0).alias("tem_pista"), T.pace(F.size("_toks"), F.col("duracao")).alias("pace"), T.emotion_impact(T.tokens(t)).alias("densidade_impacto"), F.struct(*map(tone, ARC)).alias("tom"),
        T.cta_sentences(t).alias("_chamadas"), *[c.alias(f"_bag_{k}") for k, c in lists.items()],
    ).withColumns({"gancho_tom": T.sentiment(T.polarity(F.col("gancho"))), "gancho_impacto": T.impact_score(F.col("gancho")), "gancho_palavras": F.size(T.ws_tokens(F.col("gancho")))})


def pattern_scalars(rows: DataFrame, niche: str = "nicho", wanted: Sequence[str] | None = None) -> DataFrame:
    """Modes, means and shares of each niche in one aggregate, and its medians, all in one pass of exact quantiles; of the medians only those ``wanted``."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    first = lambda c: F.char_length(T.first_line(F.col(c)))
    some = lambda c: F.when(F.trim(c) != "", F.col(c))
    tails = {f"_{k}": F.when(F.size("palavras_chave") > 0, F.col(f"_chave.proporcao.{k}")) for k in ("shorttail", "midtail", "longtail")}
    medians = {
        "titulo_comprimento": F.col("titulo_comprimento"), "gancho_comprimento": F.char_length("gancho"), "gancho_palavras": F.col("gancho_palavras"), "palavras": F.col("n_words"), "frase_media": F.col("ritmo.mean"),
        "frase_variancia": F.col("ritmo.variance"), "pace": F.col("pace"), "densidade_impacto": F.col("densidade_impacto"), "cta_score": F.col("cta.score"), "maior_repeticao": F.col("maior_repeticao"),
        "descricao_comprimento": T.trimmed_length(F.col("descricao")), "descricao_linha": first("descricao"), "n_hashtags": F.size(T.hashtags(F.col("descricao"))), **tails,
        "capa_comprimento": F.char_length(some("texto_capa")), "capa_caps": T.caps_ratio(F.col("texto_capa")), "conversao": F.col("taxa_conversao"), "discussao": F.col("taxa_discussao"),
    }
    found = rows.groupBy(niche).agg(
        F.count("*").alias("n"), mode("titulo_formula").alias("titulo_formula"), mode("titulo_tom").alias("titulo_tom"), F.avg("titulo_caps").alias("titulo_caps"), (F.avg("titulo_impacto") >= 0.3).alias("usar_pontuacao"),
        mode("gancho_formula").alias("gancho_formula"), mode("gancho_tom").alias("gancho_tom"), F.coalesce(F.stddev_samp("gancho_palavras"), F.lit(0.0)).alias("gancho_desvio"), (F.avg("gancho_impacto") >= 0.3).alias("gancho_pontuacao"),
        mode("cta.intensidade").alias("cta_intensidade"), mode("cta.posicao").alias("cta_posicao"), share("dialogo").alias("taxa_dialogo"), share("repeticao").alias("taxa_repeticao"), share("tem_link").alias("taxa_link"),
        mode("audio").alias("audio_dominante"), share("tem_pista").alias("taxa_audio"), mode(T.sentiment(T.polarity(T.first_line(F.col("descricao"))))).alias("descricao_tom"), F.avg(T.has_person(F.col("cena")).cast("int")).alias("presenca"),
        mode(T.sentiment(T.polarity(F.coalesce("cena", F.lit(""))))).alias("cena_tom"), mode("formato").alias("formato"), *[mode(f"tom.{p}").alias(f"tom_{p}") for p in ARC],
    )
    medians = {k: c for k, c in medians.items() if wanted is None or k in wanted}
    if medians:
        found = with_groups(found, median_of(rows, medians, [niche]), [niche])
    if wanted is None or "discussao_alta" in wanted:
        high = percentiles(rows, "taxa_discussao", (0.75,), [niche]).select(niche, F.col("p")[0].alias("discussao_alta"))
        found = with_groups(found, high, [niche], "left")
    return found


def structure_patterns(rows: DataFrame, scalars: DataFrame, niche: str = "nicho") -> DataFrame:
    """(niche, estrutura_geral): the commonest format of each niche, the medians of its rows and the style they mean."""
    own = with_groups(rows, F.broadcast(scalars.select(niche, F.col("formato").alias("_formato"), "taxa_dialogo")), [niche]).where(F.col("formato").eqNullSafe(F.col("_formato")))
    medians = median_of(own, {"pace": F.col("pace"), "palavras": F.col("n_words")}, [niche]).select(niche, F.round("pace", 3).alias("pace"), F.col("palavras").cast("int").alias("palavras"))
    found = own.groupBy(niche).agg(mode("faixa").alias("faixa"), (F.avg(F.col("repeticao").cast("int")) >= 0.3).alias("repete"), F.first("taxa_dialogo").alias("dialogo"))
    found = with_groups(found, medians, [niche])
    style = (
        F.when((F.col("pace") >= 4.0) & (F.col("palavras") <= 150), "impacto_rapido").when(F.col("repete") & (F.col("pace") >= 3.5), "esquete_com_hook")
        .when(F.col("palavras") >= 400, "narrativa").otherwise("esquete")
    )
    fields = (style.alias("estrutura_blocos"), F.col("faixa").alias("faixa_duracao"), F.col("palavras").alias("limite_palavras"), (F.round("dialogo", 3) >= 0.3).alias("usa_dialogo"), F.round("dialogo", 3).alias("taxa_dialogo_no_nicho"), F.col("repete").alias("usa_repeticao"))
    return found.select(niche, F.struct(*fields).alias("estrutura_geral"))


def keyword_ratio(short: Column, mid: Column, long: Column) -> Column:
    """The medians of three shares scaled to a sum of 1; zeros if there are none."""
    total = F.coalesce(short, F.lit(0.0)) + F.coalesce(mid, F.lit(0.0)) + F.coalesce(long, F.lit(0.0))
    part = lambda c: F.round(F.coalesce(F.try_divide(F.coalesce(c, F.lit(0.0)), total), F.lit(0.0)), 3)
    return F.struct(part(short).alias("shorttail"), part(mid).alias("midtail"), part(long).alias("longtail"))


def conversion_intensity(rate: Column) -> Column:
    return F.when(rate >= 5.0, "direto").when(rate >= 2.0, "moderado").otherwise("suave")


def pattern_bags(rows: DataFrame, scalars: DataFrame, niche: str = "nicho", bags: dict[str, int] = BAGS) -> DataFrame:
    """(niche, kind, a, b, n, rank): the commonest terms of every bag of the document.

    The short lists of a row are counted in one aggregate. Words, bigrams and window pairs are mostly rare: they are counted by
    ``top_counts_of_rows``, which does not shuffle the rare ones. Words of a third count for the rows whose tone there is the
    niche's, and twice over if those hold too few different words: such thirds are counted again.
    """
    tone = scalars.select(niche, *[F.col(f"tom_{p}").alias(f"_{p}") for p in ARC], F.col("cta_intensidade").alias("_cta"), F.col("cta_posicao").alias("_posicao"))
    toned = with_groups(rows, F.broadcast(tone), [niche])  # one row a niche; rows stay where they are
    size = F.element_at(F.create_map(*[F.lit(x) for kv in bags.items() for x in kv]), F.col("kind"))
    out = [niche, "kind", "a", "b", "n", "rank"]
    # Equal texts are one row of the part that is looked at first.
    own = rows.select(niche, F.xxhash64("_content").alias("_row"), "_content")
    pair = lambda k: F.struct(F.when(F.col("_0") != F.col(f"_{k}"), F.least("_0", f"_{k}")).alias("a"), F.greatest("_0", f"_{k}").alias("b"))
    rare = {"moldes": [F.struct(F.when(F.col("_1").isNotNull(), F.concat_ws(" ", "_0", "_1")).alias("a"), F.lit("").alias("b"))], "pares": [pair(k) for k in range(1, 6)]}
    found = []
    for kind in (k for k in rare if k in bags):  # each by itself: the counts of one would hide how rare the terms of the other are
        pairs = P.shifted(own, F.col("_content"), [niche, "_row"], len(rare[kind])).select(niche, "_row", F.inline(F.array(*rare[kind]))).where("a is not null")
        common = term_bags.top_counts_of_rows(pairs, "_row", [niche], bags[kind], ("a", "b"), scalars.select(niche), hashes=2)
        found.append(common.withColumn("kind", F.lit(kind)).select(*out))
    # No terms of calls to action are looked for in a niche whose descriptions hold none.
    without = (F.col("_cta") == "ausente") & (F.col("_posicao") == "ausente")
    small = [F.when(without, F.array()).otherwise(F.col("_bag_cta")) if k == "cta" else F.col(f"_bag_{k}") for k in bags if f"_bag_{k}" in rows.columns]
    if small:
        listed = toned.select(niche, F.inline(F.concat(*small))).where("a is not null")
        found.append(term_bags.top_counts(listed, [niche, "kind"], max(bags.values()), ("a", "b")).where(F.col("rank") <= size).select(*out))
    kinds = [k for k in ("vocabulario", *ARC) if k in bags]
    if kinds:
        words = _words(toned, niche, kinds)
        groups = scalars.select(niche, F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
        common = term_bags.top_counts_of_rows(words.where("keep"), "_row", [niche, "kind"], max(bags[k] for k in kinds), groups=groups).where(F.col("rank") <= size)
        if arcs := [k for k in kinds if k in ARC]:
            some = common.groupBy(niche, "kind").agg(F.count("*").alias("_some"))
            few = with_groups(groups.where(F.col("kind").isin(*arcs)), some, [niche, "kind"], "left").where(F.coalesce("_some", F.lit(0)) < size).select(niche, "kind", F.lit(True).alias("_few"))
            common = with_groups(common, F.broadcast(few), [niche, "kind"], "left").where("_few is null").drop("_few")
            again = with_groups(words, F.broadcast(few), [niche, "kind"]).groupBy(niche, "kind", "term").agg((F.count_if("keep") + F.count("*")).alias("n"))
            common = common.unionByName(top_rows(again, [niche, "kind"], [F.desc("n"), F.asc("term")], max(bags[k] for k in arcs), rank="rank").where(F.col("rank") <= size))
        found.append(common.withColumns({"a": F.col("term"), "b": F.lit("")}).select(*out))
    return reduce(lambda x, y: x.unionByName(y), found)


def _words(rows: DataFrame, niche: str, kinds: Sequence[str]) -> DataFrame:
    """(niche, _row, kind, term, keep): the words of ``rows``, which know the tones of their niche, and those of their thirds."""
    ready = rows.select(niche, F.xxhash64("_content").alias("_row"), *[F.coalesce(F.col(f"tom.{p}") == F.col(f"_{p}"), F.lit(False)).alias(f"_keep_{p}") for p in ARC], "_content")
    third = F.when(F.col("_i") < F.floor(F.col("_n") * 0.2), "inicio").when(F.col("_i") < F.floor(F.col("_n") * 0.8), "meio").otherwise("fim")
    toned = F.when(third == "inicio", F.col("_keep_inicio")).when(third == "meio", F.col("_keep_meio")).otherwise(F.col("_keep_fim"))
    term = lambda kind, keep: F.struct(kind.alias("kind"), F.col("_0").alias("term"), keep.alias("keep"))
    own = [term(F.lit("vocabulario"), F.lit(True))] if "vocabulario" in kinds else []
    if any(k in ARC for k in kinds):
        own.append(term(third, toned))
    tokens = P.shifted(ready, F.col("_content"), [niche, "_row", *[f"_keep_{p}" for p in ARC]], 0)
    return tokens.select(niche, "_row", F.inline(F.array(*own))).where(F.col("kind").isin(*kinds))


#: What a topic's candidate terms are compared as, the least cosine, the least length and the number that stay.
MEANINGS = {
    "titulo": ("this video is about %s", 0.28, 4, 20), "descricao": ("this video is about %s", 0.28, 4, 20), "moldes": ("this video description contains the phrase %s", 0.28, 0, 10),
    "capa": ("this video thumbnail text says %s", 0.28, 4, 15), "cena": ("this video thumbnail scene shows %s", 0.28, 4, 15), "gancho": ("this video hook starts with %s", 0.25, 4, 15), "cta": ("call to action asking viewer to %s", 0.3, 0, 10),
}
#: The two labels between which a sentence is a call to action or not, the margin, and the sentences that a niche needs.
CALL, NO_CALL, CALL_MARGIN, LEAST_CALLS = "subscribe like comment share follow the channel call to action", "narrative context storytelling describing events or dialogue", 0.05, 3
#: Topics with examples, and how many each has.
EXAMPLES, EXAMPLE_COUNT = ("titulo", "descricao", "capa", "gancho"), 3


def topic_texts(rows: DataFrame, row: str, niche: str = "nicho") -> DataFrame:
    """(niche, topic, row, text, toks): the texts whose meanings the document is about, one for each row and topic, calls to action one for each sentence.

    The tokens of ``moldes`` are single words; ``meant_terms`` makes phrases of two and three of them, which no table holds.
    """
    content = lambda c: T.content_tokens(F.col(c))
    bag = lambda k: F.transform(f"_bag_{k}", lambda s: s["a"])
    topic = lambda name, text, toks: F.struct(F.lit(name).alias("topic"), F.coalesce(text, F.lit("")).alias("text"), toks.alias("toks"))
    described = F.col("_descricao" if "_descricao" in rows.columns else "_content")
    words = F.filter(described, lambda t: t.rlike("^[a-z]{3,}$"))
    clean = F.transform("_chamadas", lambda s: topic("cta", s, F.array().cast("array<string>")))
    topics = F.array(
        topic("titulo", T.clean_title(F.col("titulo")), bag("titulo")), topic("descricao", F.col("descricao"), described), topic("moldes", F.col("descricao"), words),
        topic("capa", T.clean_cover(F.col("texto_capa")), bag("capa")), topic("cena", F.col("cena"), bag("cena")), topic("gancho", F.col("gancho"), content("gancho")),
    )
    long = rows.select(niche, F.col(row).alias("row"), F.inline(F.concat(topics, clean)))
    return long.withColumn("toks", F.when(F.col("topic") == "cta", content("text")).otherwise(F.col("toks")))


def meant_terms(texts: DataFrame, vectors_of: Callable[[DataFrame], DataFrame], niche: str = "nicho", k: int = 50) -> DataFrame:
    """(niche, topic, term, rank): of the ``k`` candidates with the largest mean TF-IDF of each topic those near its mean text, in the order of the candidates.

    A sentence counts as a call to action if it is nearer to the one label than to the other by the margin; a
    niche with fewer than LEAST_CALLS of them has no terms there. Only distinct texts and phrases are encoded.
    """
    spark = texts.sparkSession
    by = [niche, "topic"]
    labels = spark.createDataFrame([(CALL,), (NO_CALL,)], "text string")
    marked = texts.where("topic <> 'cta'").withColumn("part", F.xxhash64("row"))
    of_terms = marked.where("topic <> 'moldes'").select(*by, "part", F.explode("toks").alias("term"))
    of_phrases = P.ngram_rows(marked.where("topic = 'moldes'"), F.col("toks"), [*by, "part"], (2, 3))
    sizes = marked.groupBy(*by).agg(F.count("*").alias("_rows"))
    # Phrases by themselves: their counts would hide how rare words are.
    of_texts = reduce(lambda x, y: x.unionByName(y), [terms.candidates_of(x, sizes.where(at), "part", by, k, k) for x, at in ((of_terms, "topic <> 'moldes'"), (of_phrases, "topic = 'moldes'"))])
    # The texts of phrases are those of descriptions.
    text_vectors = vectors_of(texts.where("topic <> 'moldes'").select("text"))
    by_text = lambda wanted, *more: with_vectors(texts.where(wanted).select(*by, "text", *more), text_vectors)
    label_vectors = with_vectors(labels, vectors_of(labels), few=True)
    label = lambda t: label_vectors.where(F.col("text") == t).select(F.col("vector").alias("_v"))  # noqa: E731  # one row
    calls = by_text("topic = 'cta'", "row", "toks").crossJoin(F.broadcast(label(CALL).toDF("_call"))).crossJoin(F.broadcast(label(NO_CALL).toDF("_other")))
    calls = terms.zero_shot(calls, "vector", F.col("_call"), F.col("_other"), CALL_MARGIN).select(niche, "topic", "row", "text", "toks", "vector")
    calls = stored(calls, "calls")
    enough = calls.groupBy(niche).agg(F.count("*").alias("_calls")).where(F.col("_calls") >= LEAST_CALLS)
    calls = with_groups(calls, enough, [niche]).drop("_calls")
    called = terms.candidate_terms(calls.withColumn("part", F.xxhash64("row", "text")), F.col("toks"), "part", by, k, k)
    candidates = stored(of_texts.unionByName(called), "candidates")  # at most ``k`` for each niche and topic
    centres = vectors.centroids(by_text("topic <> 'cta'").select(*by, "vector").unionByName(calls.select(*by, "vector")), "vector", by)
    rule = lambda i: F.element_at(F.create_map(*[F.lit(x) for t, r in MEANINGS.items() for x in (t, r[i])]), F.col("topic"))
    phrased = candidates.withColumn("text", F.replace(rule(0), F.lit("%s"), F.col("term")))
    scored = with_groups(with_vectors(phrased, vectors_of(phrased.select("text")), few=True), centres, by)
    near = scored.where((vectors.cosine(F.col("vector"), F.col("centroid")) >= rule(1)) & (F.char_length("term") >= rule(2))).select(niche, "topic", "term", F.col("rank").alias("_rank"))
    kept = top_rows(near, [niche, "topic"], [F.asc("_rank")], max(r[3] for r in MEANINGS.values()), rank="rank")
    return kept.where(F.col("rank") <= rule(3)).drop("_rank")


def diverse_examples(texts: DataFrame, vector: DataFrame, niche: str = "nicho", k: int = EXAMPLE_COUNT) -> DataFrame:
    """(niche, topic, exemplos): the first ``k`` of the picks of each density cluster, in the order of the clusters.

    ``texts`` is (niche, topic, row, text). A cluster gives the text nearest to its mean and, from three texts on, the two
    others that are least alike; where no cluster has a text the whole topic is taken for one. Texts of fewer than three
    words take part in the clusters but are no examples.
    """
    rows = with_vectors(texts, vector).withColumn("_id", F.xxhash64(niche, "topic", "row"))
    rows = stored(rows.withColumn("_group", F.xxhash64(F.coalesce(niche, F.lit("")), F.col(niche).isNull(), "topic")), "examples")
    with passing(texts.sparkSession) as kept:
        found = kept(density.density_clusters(rows, "_id", "vector", "_group"), "clusters")
    fit = rows.join(found, ["_group", "_id"]).where(F.size(T.ws_tokens(F.col("text"))) >= 3)
    some = fit.groupBy("_group").agg(F.max(F.col("cluster") >= 0).alias("_some"))
    pool = stored(fit.join(some, "_group").where(F.col("cluster").cast("int") >= F.when(F.col("_some"), 0).otherwise(-1)), "pool")
    picks = vectors.representatives(pool, "_id", "vector", ["_group", "cluster"], pairs=vectors.stored_farthest_pairs)
    pairs = pool.groupBy("_group", "cluster").agg(F.count("*").alias("_n"))
    picks = picks.join(pairs, ["_group", "cluster"]).where((F.col("pick") == 1) | (F.col("_n") > 2) | (F.col("cluster") < 0))
    ordered = top_rows(picks, ["_group"], [F.asc("cluster"), F.asc("pick"), F.asc("_id")], k, rank="_place")
    shown = ordered.join(pool.select("_group", "_id", niche, "topic", "text"), ["_group", "_id"])
    return shown.groupBy(niche, "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "text"))), lambda s: s["text"]).alias("exemplos"))


def example_texts(rows: DataFrame, scalars: DataFrame, row: str, niche: str = "nicho") -> DataFrame:
    """(niche, topic, row, text): the texts that may be examples. Descriptions of 50 to 500 characters and hooks that are
    long enough for their niche and hold no long number; all of a niche's where none is.
    """
    cut = scalars.select(niche, F.greatest(F.lit(5), F.floor(F.col("gancho_palavras") - F.col("gancho_desvio"))).alias("_cut"))
    size = F.char_length(F.trim("text"))
    topics = F.array(*[F.struct(F.lit(t).alias("topic"), F.coalesce(c, F.lit("")).alias("text")) for t, c in (("titulo", "titulo"), ("descricao", "descricao"), ("capa", "texto_capa"), ("gancho", "gancho"))])
    long = with_groups(rows, F.broadcast(cut), [niche]).select(niche, F.col(row).alias("row"), "_cut", F.inline(topics))
    fit = F.when(F.col("topic") == "descricao", size.between(50, 500)).when(F.col("topic") == "gancho", (F.size(T.ws_tokens(F.col("text"))) >= F.col("_cut")) & ~F.col("text").rlike(r"\b\d{4,}\b")).otherwise(True)
    long = long.withColumn("_fit", fit).drop("_cut")
    some = long.groupBy(niche, "topic").agg(F.max("_fit").alias("_any"))
    return with_groups(long, F.broadcast(some), [niche, "topic"]).where(F.col("_fit") | ~F.col("_any")).drop("_fit", "_any")


def pattern_documents(df: DataFrame, niche: str = "nicho", text: str = "texto", row: str = "id", load: Callable[[], Encoder] = HashedGrams, cache: str | None = None) -> DataFrame:
    """The nested document of each niche: five topics of structure and eight of script.

    Features, meanings and examples are stored tables of the shared folder; vectors and clusters are removed when these stand. ``load``
    makes the model of text vectors, ``cache`` is the folder that remembers them over runs. A null niche is a niche.
    """
    found = features(spread(df), niche, text)
    rows = stored(found if text in INPUTS else found.drop(text), "features")  # what is read of the text are its features
    scalars = stored(pattern_scalars(rows, niche), "scalars")  # one row a niche
    # One after the other, so that only one of them has shuffles at a time.
    bags = reduce(lambda x, y: x.unionByName(y), [stored(pattern_bags(rows, scalars, niche, some), "bags") for some in ({"pares": BAGS["pares"]}, {"moldes": BAGS["moldes"]}, {k: n for k, n in BAGS.items() if k not in ("pares", "moldes")})])
    with passing(df.sparkSession) as kept:  # vectors and what the clusters need take more room than all else
        memory = cache or new_folder(df.sparkSession, "vectors")
        vectors_of = lambda texts: remembered(texts, "text", load, memory)
        meant = kept(meant_terms(topic_texts(rows, row, niche), vectors_of, niche), "meant")
        shown = example_texts(rows, scalars, row, niche)
        examples = kept(diverse_examples(shown, vectors_of(shown), niche), "shown")
    entry = F.struct("rank", "a", "b", "n")
    packed = bags.groupBy(niche).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))).alias(f"_{k}_bag") for k in BAGS])
    own = meant.groupBy(niche).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("topic") == k, F.struct("rank", "term")))), lambda s: s["term"]).alias(f"_{k}_meant") for k in MEANINGS])
    texts = examples.groupBy(niche).agg(*[F.max(F.when(F.col("topic") == k, F.col("exemplos"))).alias(f"_{k}_examples") for k in EXAMPLES])
    out = scalars
    for part in (packed, own, texts, structure_patterns(rows, scalars, niche)):
        out = with_groups(out, part, [niche], "left")
    none = F.array().cast("array<string>")
    meant_of, examples_of = (lambda k: F.coalesce(f"_{k}_meant", none)), (lambda k: F.coalesce(f"_{k}_examples", none))
    terms = lambda k: F.transform(F.coalesce(f"_{k}_bag", F.array()), lambda s: s["a"])
    counted = lambda k, name: F.transform(F.coalesce(f"_{k}_bag", F.array()), lambda s: F.struct(s["a"].alias(name), s["n"].alias("frequencia")))
    slot = lambda s: F.struct(s["a"].alias("dia"), s["b"].alias("janela"), s["n"].alias("quantidade_virais"), F.format_string("%s %s: %.1f%%", s["a"], s["b"], 100.0 * s["n"] / F.col("n")).alias("justificativa"))
    title = F.struct(
        F.col("titulo_formula").alias("formula_construcao"), F.col("titulo_comprimento").cast("int").alias("comprimento_alvo_chars"), meant_of("titulo").alias("termos_obrigatorios"), terms("titulo").alias("termos_frequentes"), F.round("titulo_caps", 3).alias("caps_intensidade"),
        F.transform(F.coalesce("_titulo_emojis_bag", F.array()), lambda s: F.struct(s["a"].alias("emoji"), s["b"].alias("posicao"), s["n"].alias("frequencia"))).alias("emojis"), F.col("usar_pontuacao").alias("usar_pontuacao_impacto"), F.col("titulo_tom").alias("sentimento_alvo"), examples_of("titulo").alias("exemplos_reais"),
    )
    described = F.struct(
        F.col("descricao_comprimento").cast("int").alias("comprimento_alvo_chars"), F.col("descricao_linha").cast("int").alias("primeira_linha_comprimento_alvo"), F.col("descricao_tom").alias("sentimento_primeira_linha"), meant_of("descricao").alias("termos_seo_obrigatorios"), terms("descricao").alias("termos_primeira_linha"),
        meant_of("moldes").alias("moldes_frase"), counted("descricao_emojis", "emoji").alias("emojis"), F.col("cta_posicao").alias("cta_posicao"), F.col("cta_intensidade").alias("cta_intensidade"), F.round("cta_score", 3).alias("cta_score_mediano"),
        (F.col("taxa_link") >= 0.3).alias("usar_links"), terms("hashtags").alias("hashtags"), F.least(F.col("n_hashtags").cast("int"), F.size(F.coalesce("_hashtags_bag", F.array()))).alias("quantidade_hashtags"), examples_of("descricao").alias("exemplos_reais"),
    )
    cover = F.struct(F.col("capa_comprimento").cast("int").alias("comprimento_alvo_chars"), meant_of("capa").alias("termos_obrigatorios"), terms("capa").alias("termos_frequentes"), F.round("capa_caps", 3).alias("caps_intensidade"), counted("capa_emojis", "emoji").alias("emojis"), F.col("cena_tom").alias("sentimento_alvo"))
    thumbnail = F.struct(cover.alias("texto_capa"), F.struct(meant_of("cena").alias("elementos_obrigatorios"), F.round("presenca", 3).alias("presenca_humana")).alias("cena_visual"), F.col("cena_tom").alias("sentimento_visual_alvo"), examples_of("capa").alias("exemplos_reais"))
    keys = F.struct(*[terms(k).alias(k) for k in ("shorttail", "midtail", "longtail")], keyword_ratio(F.col("_shorttail"), F.col("_midtail"), F.col("_longtail")).alias("proporcao_ideal"))
    hook = F.struct(
        F.col("gancho_formula").alias("formula_abertura"), F.col("gancho_palavras").cast("int").alias("comprimento_alvo_palavras"), F.col("gancho_comprimento").cast("int").alias("comprimento_alvo_chars"), F.col("gancho_tom").alias("sentimento_alvo"),
        meant_of("gancho").alias("termos_obrigatorios"), F.col("gancho_pontuacao").alias("usar_pontuacao_impacto"), examples_of("gancho").alias("exemplos_reais"),
    )
    rhythm = F.struct(F.round("pace", 3).alias("palavras_por_segundo"), F.round("frase_media", 3).alias("comprimento_medio_frase"), F.round("frase_variancia", 3).alias("variancia_ritmo"), F.round("densidade_impacto", 3).alias("densidade_pontuacao_impacto"), terms("moldes").alias("moldes_frase"))
    arc = F.struct(*[F.struct(F.col(f"tom_{p}").alias("tom"), terms(p).alias("vocabulario_obrigatorio")).alias(p) for p in ARC])
    audio = F.struct(F.coalesce("audio_dominante", F.lit("desconhecido")).alias("tipo_dominante"), counted("pistas", "pista").alias("clima_sonoro"), F.round("taxa_audio", 3).alias("frequencia_uso_no_nicho"))
    calls = F.struct(
        conversion_intensity(F.col("conversao")).alias("intensidade"), F.col("cta_intensidade").alias("estilo"), F.coalesce(F.col("discussao") >= F.col("discussao_alta"), F.lit(False)).alias("ativar_gatilho_debate"),
        F.round("discussao", 3).alias("taxa_discussao_mediana"), F.round("cta_score", 3).alias("cta_score_mediano"), F.col("cta_posicao").alias("posicao"), meant_of("cta").alias("molde_termos"), terms("cta").alias("termos_frequentes"),
    )
    repeated = F.struct((F.col("taxa_repeticao") >= 0.3).alias("ativar"), F.round("taxa_repeticao", 3).alias("taxa_no_nicho"), F.col("maior_repeticao").alias("frequencia_media"))
    words = F.struct(terms("vocabulario").alias("termos_obrigatorios"), F.transform(F.coalesce("_pares_bag", F.array()), lambda s: F.array(s["a"], s["b"])).alias("coocorrencias_obrigatorias"))
    posting = F.struct(F.transform(F.coalesce("_slots_bag", F.array()), slot).alias("top_3_slots"))
    return out.select(
        niche, "n",
        F.struct(title.alias("titulo"), described.alias("descricao"), keys.alias("palavras_chave"), thumbnail.alias("thumbnail"), posting.alias("postagem")).alias("structure_content"),
        F.struct(F.col("estrutura_geral"), hook.alias("gancho"), rhythm.alias("ritmo_linguagem"), arc.alias("arco_emocional"), audio.alias("audio"), repeated.alias("repeticao"), calls.alias("cta"), words.alias("vocabulario_geral")).alias("script_content"),
    )


def missing_fields(documents: DataFrame, required: dict[str, str], key: str = "nicho") -> DataFrame:
    """Validation of documents given as JSON text: for each one the required paths that are absent, null or empty.

    ``required`` maps a path (``block.topic.field``) to a column with the block's JSON. Lists and texts
    must not be empty; a document that is no JSON lacks everything.
    """
    found = [F.when(_empty(F.get_json_object(F.col(column), f"$.{path}")), F.lit(f"{column}.{path}")) for path, column in required.items()]
    return documents.select(key, F.filter(F.array(*found), lambda x: x.isNotNull()).alias("faltando"))


def _empty(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin("", "[]", "{}", "null")
