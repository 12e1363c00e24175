"""Text features as Column expressions: tokenising, lengths, capitals, calls to action, scripts.

All take and return Columns, so Catalyst sees the whole feature set as one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .positional import has_run, let, max_repeat

EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}](?:[\x{FE0F}\x{1F3FB}-\x{1F3FF}]|\x{200D}[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]\x{FE0F}?)*"
URL = r"https?://\S+"
SCRIPTS = {"latin": "IsLatin", "cyrillic": "IsCyrillic", "arabic": "IsArabic", "greek": "IsGreek", "han": "IsHan", "hangul": "IsHangul", "hiragana": "IsHiragana", "katakana": "IsKatakana", "devanagari": "IsDevanagari", "hebrew": "IsHebrew", "thai": "IsThai"}


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def none_if_blank(c: Column) -> Column:
    return F.when(~blank(c), c)


def ws_tokens(c: Column) -> Column:
    """Runs of characters other than white space; null: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-case words of at least ``least`` characters without URLs, [cues], (asides), #tags and @names."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)https?://\S+|\[[^\]]*\]|\([^)]*\)|[#@]\w+", " ")
    return F.filter(F.regexp_extract_all(bare, F.lit(r"(?U)\w+"), F.lit(0)), lambda t: F.char_length(t) >= least)


def content_tokens(c: Column, stop: Sequence[str] = tuple(W.STOP_WORDS)) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(*stop))


def sentences(c: Column) -> Column:
    """Parts between full stops, question and exclamation marks, longer than five characters."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.!?]+"), lambda s: F.trim(s)), lambda s: F.char_length(s) > 5)


def first_line(c: Column) -> Column:
    return F.trim(F.element_at(F.split(F.trim(F.coalesce(c, F.lit(""))), "\n"), 1))


def trimmed_length(c: Column) -> Column:
    return F.coalesce(F.char_length(F.trim(c)), F.lit(0))


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, 0 where b is 0."""
    out = F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def is_caps(t: Column) -> Column:
    return (F.upper(t) == t) & (F.lower(t) != t) & (F.char_length(t) > 1)


def caps_ratio(c: Column) -> Column:
    toks = ws_tokens(c)
    return ratio(F.size(F.filter(toks, is_caps)), F.size(toks), 3)


def letter_caps_ratio(c: Column) -> Column:
    """Share of capital letters among letters."""
    return ratio(F.regexp_count(c, F.lit(r"\p{Lu}")), F.regexp_count(c, F.lit(r"\p{L}")), 3)


def impact_score(c: Column) -> Column:
    """0.5 for an exclamation or question mark, 0.25 for each intensifier, those at most 0.5; three digits."""
    hits = F.size(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: w.isin(*W.INTENSIFIERS)))
    mark = F.when(c.rlike("[!?]"), 0.5).otherwise(0.0)
    return F.when(blank(c), 0.0).otherwise(F.round(F.least(mark + F.least(0.25 * hits, F.lit(0.5)), F.lit(1.0)), 3))


def has_link(c: Column) -> Column:
    return F.coalesce(c.rlike(URL), F.lit(False))


def link_line_share(c: Column) -> Column:
    """Share of the non-blank lines that hold a URL."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return ratio(F.size(F.filter(lines, lambda x: x.rlike(URL))), F.size(lines), 3)


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)#(\w+)"), F.lit(1))


def mention_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)@\w+")), F.lit(0))


def emojis(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMOJI), F.lit(0))


def emoji_positions(c: Column) -> Column:
    """(emoji, posicao) for each emoji code point: first fifth, last fifth or between."""

    def spots(text: Column) -> Column:
        size = F.char_length(text)
        chars = F.transform(F.split(text, ""), lambda ch, i: F.struct(ch.alias("emoji"), position_class(i, size).alias("posicao")))
        return F.filter(chars, lambda e: e["emoji"].rlike(rf"^(?:{EMOJI})$"))

    # Most texts hold none; the others are taken apart once.
    return F.when(c.rlike(EMOJI), let(c, spots)).otherwise(F.array().cast("array<struct<emoji:string,posicao:string>>"))


def position_class(at: Column, size: Column) -> Column:
    share = F.try_divide(at.cast("double"), size)
    return F.when(share <= 0.2, "inicio").when(share >= 0.8, "fim").otherwise("meio")


def audio_cues(c: Column) -> Column:
    """Distinct [..], (..) and note signs in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[.*?\]|\(.*?\)|♪"), F.lit(0)))


def dominant_cue(c: Column) -> Column:
    """The commonest cue of a text; ties: the first to appear."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[.*?\]|\(.*?\)|♪"), F.lit(0))
    entry = lambda every, x, i: F.struct(F.size(F.filter(every, lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("cue"))
    return let(found, lambda every: F.array_max(F.transform(F.array_distinct(every), lambda x, i: entry(every, x, i)))["cue"])


def is_dialogue(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(">>")) >= 2, F.lit(False))


def clean_transcript(c: Column) -> Column:
    """Without cues, speaker marks and repeated blanks."""
    out = F.regexp_replace(c, r"\[.*?\]|\(.*?\)|♪", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)>>\s*[\w\s]+:", " "), ">>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def plain(c: Column, keep: str = "") -> Column:
    """Lower case, words only (and the characters in ``keep``), single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), rf"(?U)[^\w\s{keep}]", " "), r"\s+", " "))


def clean_title(c: Column) -> Column:
    """Without #tags, @names and emoji."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"#\S+|@\S+", ""), EMOJI, ""))


def clean_cover(c: Column) -> Column:
    """Cover text: the title's cleaning, and tokens with a digit or underscore go."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean_title(c), r"\S*[\d_]\S*", ""), r"\s+", " "))


def sentiment_input(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"http\S+", "http"), r"(?U)@\w+", "@user"), 1, 512)


def hook(c: Column, k: int = 15) -> Column:
    """The first ``k`` white-space tokens."""
    return F.array_join(F.slice(ws_tokens(c), 1, k), " ")


def hook_flags(c: Column) -> Column:
    """Opening patterns of a hook: seven flags in one struct."""
    low = F.lower(F.coalesce(c, F.lit("")))
    first = F.regexp_extract(low, r"(?U)^\W*([\w']+)", 1)
    has = lambda ws: low.rlike(r"(?U)\b(" + "|".join(ws) + r")\b")
    return F.struct(
        (first.isin(*W.QUESTION_WORDS) | low.rlike(r"\?")).alias("question"),
        first.isin(*W.IMPERATIVE_WORDS).alias("imperative"),
        has(W.PROBLEM_WORDS).alias("problem"),
        has(W.PROMISE_WORDS).alias("promise"),
        has(W.POLEMIC_WORDS).alias("polemic"),
        low.rlike(r"^\s*\d").alias("number"),
        low.rlike("[?!]").alias("mark"),
    )


def opening_formula(c: Column) -> Column:
    """pergunta, imperativo or afirmacao: the lexicon stand-in for a parser."""
    first = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"(?U)^\W*([\w']+)", 1)
    return F.when(first.isin(*W.QUESTION_WORDS), "pergunta").when(first.isin(*W.IMPERATIVE_WORDS), "imperativo").otherwise("afirmacao")


def cta(c: Column) -> Column:
    """Call to action: (label, score, place) from distinct phrases and words of urgency."""
    low = F.lower(F.coalesce(c, F.lit("")))
    verb = r"(?U)\b(" + "|".join(W.CTA_VERBS) + r")\b"
    n = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(verb), F.lit(1))))
    urgent = low.rlike("|".join(W.URGENCY_WORDS))
    score = F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.2 * n + F.when(urgent, 0.3).otherwise(0.0)))
    label = (
        F.when(n == 0, "ausente").when((n >= 3) | ((n >= 2) & urgent), "direto").when((n == 2) | urgent, "moderado").otherwise("suave")
    )
    at = F.regexp_instr(low, F.lit(verb))
    place = F.when(at == 0, "ausente").otherwise(position_class(at - 1, F.char_length(low)))
    return F.struct(label.alias("intensidade"), F.round(score, 3).alias("score"), place.alias("posicao"))


def cta_sentences(c: Column) -> Column:
    """Sentences of three or more words that hold a verb of a call to action."""
    verb = r"(?iU)\b(" + "|".join(W.CALL_VERBS) + r")\b"
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.!?]+"), F.trim), lambda s: s.rlike(verb) & (F.size(F.split(s, r"\s+")) >= 3))


def cta_terms(c: Column) -> Column:
    """Words of the sentences of three or more words that hold a verb of a call to action."""
    verb = r"(?U)\b(" + "|".join(W.CALL_VERBS) + r")\b"
    acts = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[.!?]+"), lambda s: s.rlike(verb) & (F.size(F.split(F.trim(s), r"\s+")) >= 3))
    return F.filter(F.regexp_extract_all(F.array_join(acts, " "), F.lit(r"(?U)\w+"), F.lit(0)), lambda t: (F.char_length(t) >= 3) & ~t.isin(*W.STOP_WORDS))


def has_person(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"(?U)\b(" + "|".join(W.PERSON_WORDS) + r")s?\b"), F.lit(False))


def comma_terms(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def keyword_tails(terms: Column) -> Column:
    """Terms of one, two and three or more words, and their shares."""
    n = lambda t: F.size(F.split(t, r"\s+"))
    short, mid, long = F.filter(terms, lambda t: n(t) == 1), F.filter(terms, lambda t: n(t) == 2), F.filter(terms, lambda t: n(t) >= 3)
    share = lambda part: ratio(F.size(part), F.size(terms), 3)
    return F.struct(short.alias("shorttail"), mid.alias("midtail"), long.alias("longtail"), F.struct(share(short).alias("shorttail"), share(mid).alias("midtail"), share(long).alias("longtail")).alias("proporcao"))


def list_literal(c: Column) -> Column:
    """A list written as text, in brackets or comma separated, as lower-case items; quoted items may hold commas and escapes."""
    inner = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*\[|\]\s*$", "")
    single, double = r"'(?:[^'\\]|\\.)*'", r'"(?:[^"\\]|\\.)*"'
    items = F.regexp_extract_all(inner, F.lit(rf"(?:^|,)\s*({single}|{double}|[^,]*?)\s*(?=,|$)"), F.lit(1))
    quoted = lambda t: t.rlike(f"^(?:{single}|{double})$")
    bare = lambda t: F.when(quoted(t), F.regexp_replace(F.substring(t, F.lit(2), F.char_length(t) - 2), r"\\(.)", "$1")).otherwise(F.regexp_replace(F.trim(t), r"^['\"]+|['\"]+$", ""))
    return F.filter(F.transform(items, lambda t: F.lower(F.trim(bare(t)))), lambda t: t != "")


def slug(url: Column) -> Column:
    """Last path segment of a URL, decoded, underscores as blanks, lower case."""
    last = F.element_at(F.split(F.regexp_replace(F.trim(url), "/+$", ""), "/"), -1)
    return F.lower(F.trim(F.replace(F.coalesce(F.try_url_decode(last), last), F.lit("_"), F.lit(" "))))


def type_token_ratio(toks: Column) -> Column:
    return ratio(F.size(F.array_distinct(toks)), F.size(toks), 3)


def sentence_rhythm(c: Column) -> Column:
    """Mean and population variance of sentence lengths in words (variance 0 below two sentences)."""
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))

    def rhythm(sizes: Column) -> Column:
        n = F.size(sizes)
        both = let(ratio(total(sizes, lambda x: x), n), lambda mean: F.struct(mean.alias("mean"), total(sizes, lambda x: (x - mean) * (x - mean)).alias("spread")))
        return let(both, lambda s: F.struct(F.round(s["mean"], 3).alias("mean"), F.when(n < 2, 0.0).otherwise(F.round(ratio(s["spread"], n), 3)).alias("variance")))

    return let(F.transform(sentences(c), lambda s: F.size(ws_tokens(s)).cast("double")), rhythm)


def dominant_script(c: Column) -> Column:
    """Script of at least 80 % of the letters, ``mixed`` if none, ``ascii_only`` without letters."""
    text = F.coalesce(c, F.lit(""))
    others = {name: p for name, p in SCRIPTS.items() if name != "latin"}
    entry = lambda n, name: F.struct(n.alias("n"), F.lit(name).alias("name"))

    def judged(counts: Column) -> Column:
        both = F.struct(F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"]).alias("total"), F.array_max(counts).alias("top"))
        return let(both, lambda s: F.when(s["total"] == 0, "ascii_only").when(s["top"]["n"] >= 0.8 * s["total"], s["top"]["name"]).otherwise("mixed"))

    def counted(t: Column, bare: Column) -> Column:
        """Latin letters are what ``bare`` lacks; the other scripts are looked for in what is left of it without ASCII."""
        latin = entry(F.char_length(t) - F.char_length(bare), "latin")
        rest = F.regexp_replace(bare, r"[\x00-\x7F]+", "")
        return let(let(rest, lambda r: F.array(latin, *[entry(F.regexp_count(r, F.lit(rf"\p{{{p}}}")), name) for name, p in others.items()])), judged)

    bare = F.regexp_replace(text, rf"\p{{{SCRIPTS['latin']}}}+", "")
    return let(F.struct(text.alias("t"), bare.alias("bare")), lambda s: counted(s["t"], s["bare"]))


def length_score(n: Column) -> Column:
    return F.when(n.between(40, 70), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(n - 55) / 55.0))


def pace(n_words: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n_words / seconds).otherwise(0.0)


def relative_time(at: Column, now: Column) -> Column:
    """now, minutes, hours, yesterday, days, else day and month."""
    s = (F.unix_timestamp(now) - F.unix_timestamp(at)).cast("long")
    num = lambda d: F.floor(s / d).cast("string")
    return (
        F.when(at.isNull(), None).when(s < 60, "agora").when(s < 3600, F.concat(num(60), F.lit(" min"))).when(s < 86400, F.concat(num(3600), F.lit(" h")))
        .when(s < 172800, "ontem").when(s < 604800, F.concat(num(86400), F.lit(" dias"))).otherwise(F.date_format(at, "dd MMM"))
    )


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def short_label(c: Column, most: int = 35) -> Column:
    """Latin letters, digits and common marks only, cut at ``most`` with three dots."""
    kept = F.trim(F.regexp_replace(c, r"[^\p{IsLatin}\p{N}\p{P}\s]", ""))
    return F.when(F.char_length(kept) > most, F.concat(F.substring(kept, 1, most), F.lit("..."))).otherwise(kept)


def unfenced(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^```\w*\s*|```\s*$", ""), r"^\s+|\s+$", "")


def letter_run_caps(c: Column, letters: str = "A-Za-zÀ-ÖØ-öø-ÿ") -> Column:
    """Share of letter runs longer than one letter that are capitals throughout, among all letter runs."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"[{letters}]+"), F.lit(0))
    return ratio(F.size(F.filter(runs, is_caps)), F.size(runs), 3)


def repeats_word(c: Column, times: int = 5, stop: Sequence[str] = tuple(W.STOP_WORDS)) -> Column:
    """Does a word of three or more of the letters a-z, no stop word, occur at least ``times`` times?"""
    return max_repeat(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0)), lambda t: ~t.isin(*stop))) >= times


def emoji_set(c: Column) -> Column:
    """The distinct emoji, sorted, in one string."""
    return F.array_join(F.array_sort(F.array_distinct(emojis(c))), "")


def emoji_category(name: Column, categories: dict[str, str] = W.EMOJI_CATEGORIES) -> Column:
    """Category of an emoji by a part of its name; the first that fits, else outro."""
    out = F.lit("outro")
    for part, category in reversed(categories.items()):
        out = F.when(F.lower(name).contains(part), category).otherwise(out)
    return out


def emoji_name(emoji: Column, names: dict[str, str] = W.EMOJI_NAMES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), emoji)


def word_class(term: Column) -> Column:
    return F.when(term.isin(*W.ACTION_WORDS), "acao").when(term.isin(*W.EMOTIONAL_WORDS), "emocional").otherwise("tematica")


def keyword_list(url_terms: Column, category: Column, text: Column, tags: Column) -> Column:
    """Slugs, the category if there is one, hashtags of a text and tags as one sorted list without repeats, comma separated."""
    own = F.when(category.isNotNull(), F.array(category)).otherwise(F.array().cast("array<string>"))
    every = F.transform(F.concat(F.coalesce(url_terms, F.array()), own, hashtags(text), F.coalesce(tags, F.array())), lambda t: F.lower(F.trim(t)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(every, lambda t: t != ""))), ", ")


def seo_completeness(description: Column, terms: Column, text: Column) -> Column:
    """1 for a description, up to 3 for a fifth of the number of terms, and one for each hashtag, mention and emoji."""
    return F.when(blank(description), 0).otherwise(1) + F.least(F.lit(3.0), F.size(terms) / 5.0) + F.size(hashtags(text)) + mention_count(text) + F.size(emojis(text))


def title_score(c: Column, similarity: Column) -> Column:
    return similarity + F.size(emojis(c)) + F.size(hashtags(c)) + length_score(F.char_length(F.coalesce(c, F.lit(""))))


def thumbnail_score(cover: Column, scene: Column) -> Column:
    """Cover text counts 1, and up to 1 more the nearer it is to eight words or fewer; a scene up to 1 for 15 words."""
    n = F.size(ws_tokens(cover))
    words = F.when(blank(cover), 0.0).otherwise(1 + F.greatest(F.lit(0.0), 1 - F.greatest(n - 8, F.lit(0)) / 8.0))
    return words + F.when(blank(scene), 0.0).otherwise(F.least(F.lit(1.0), F.size(ws_tokens(scene)) / 15.0))


def description_score(c: Column) -> Column:
    return F.size(hashtags(c)) + F.size(emojis(c)) + F.least(F.lit(1.0), F.size(ws_tokens(F.substring(c, 1, 100))) / 15.0)


def tag_cues(c: Column) -> Column:
    """Only cues in square brackets, repeats included."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[.*?\]"), F.lit(0))


def percent(a: Column, b: Column, floor: float = 0.0) -> Column:
    """a / b in percent, rounded, at least ``floor`` and at most 100; 0 of nothing is the floor."""
    return F.least(F.lit(100.0), F.greatest(F.lit(float(floor)), F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)))))


def normal_name(c: Column, low: int = 2, high: int = 50) -> Column:
    """Trimmed lower case; null if its length is out of bounds."""
    out = F.lower(F.trim(c))
    return F.when(F.char_length(out).between(low, high), out)


def valid_email(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))


def strong_password(c: Column, least: int = 8) -> Column:
    """Long enough, with a lower-case and an upper-case letter, a digit and another character."""
    checks = [F.char_length(c) >= least, c.rlike("[a-z]"), c.rlike("[A-Z]"), c.rlike("[0-9]"), c.rlike("[^A-Za-z0-9]")]
    return F.coalesce(checks[0] & checks[1] & checks[2] & checks[3] & checks[4], F.lit(False))


def first_number(c: Column) -> Column:
    """The first number in a text, with a point or a comma."""
    return F.regexp_replace(F.regexp_extract(c, r"([0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double")


def audio_category(cue: Column) -> Column:
    """musica, riso, aplauso or efeito by the words of a cue."""
    low = F.lower(cue)
    return F.when(low.rlike("music|song|♪"), "musica").when(low.rlike("laugh"), "riso").when(low.rlike("applau|clap|cheer"), "aplauso").otherwise("efeito")


def chunks(c: Column, size: int = 1500) -> Column:
    """Parts of at most ``size`` characters that end at a word; white space is single blanks. A longer word stands cut."""
    plain = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.transform(F.regexp_extract_all(plain, F.lit(rf"\S.{{0,{size - 1}}}(?=\s|$)|\S{{1,{size}}}"), F.lit(0)), lambda x: F.rtrim(x))


def language_by_words(c: Column, default: str = "desconhecido", least: int = 10, first: int = 500) -> Column:
    """The language whose short words the first ``first`` characters hold most (ties: the first code); ``default`` below ``least`` characters or hits."""
    low = F.filter(F.regexp_extract_all(F.lower(F.substring(F.coalesce(c, F.lit("")), 1, first)), F.lit(r"(?U)\w+"), F.lit(0)), lambda t: t != "")
    hits = lambda ws: F.size(F.filter(low, lambda t: t.isin(*ws)))
    best = F.array_max(F.array(*[F.struct(hits(ws).alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(sorted(W.LANGUAGE_WORDS.items()))]))
    return F.when((F.char_length(F.coalesce(c, F.lit(""))) < least) | (best["n"] == 0), default).otherwise(best["code"])


def is_english(c: Column) -> Column:
    """No letters or at most two words count as English; else the short words decide, and none of them means English."""
    return (F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\p{L}")) == 0) | (F.size(ws_tokens(c)) <= 2) | language_by_words(c, "en", 0).isin("en")


def polarity(c: Column) -> Column:
    """(positive - negative) / (positive + negative) words; 0 without any."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    hits = lambda ws: F.size(F.filter(toks, lambda t: t.isin(*ws)))
    return let(F.struct(hits(W.POSITIVE_WORDS).alias("p"), hits(W.NEGATIVE_WORDS).alias("n")), lambda s: ratio(s["p"] - s["n"], s["p"] + s["n"]))


def sentiment(score: Column, edge: float = 0.05) -> Column:
    """positivo, negativo or neutro."""
    return F.when(score >= edge, "positivo").when(score <= -edge, "negativo").otherwise("neutro")


def emotion_impact(toks: Column, most: float = 1.0) -> Column:
    """Words of an impact emotion among all words, a word counting once for each of its emotions, at most ``most``."""
    kinds = F.create_map(*[x for w in sorted(set().union(*W.EMOTIONS.values())) for x in (F.lit(w), F.lit(sum(w in ws for ws in W.EMOTIONS.values())))])
    share = lambda own: ratio(F.aggregate(own, F.lit(0), lambda n, t: n + F.coalesce(F.element_at(kinds, t), F.lit(0))), F.size(own), 3)
    return F.least(F.lit(float(most)), F.get(F.transform(F.array(toks), share), F.lit(0)))


def noise_flags(c: Column) -> Column:
    """What a transcript holds besides words: bracketed cues, asides, note signs, a word three times in a row."""
    has = lambda p: F.coalesce(c.rlike(p), F.lit(False))
    return F.struct(has(r"\[.*?\]").alias("colchetes"), has(r"\(.*?\)").alias("parenteses"), has("♪").alias("nota"), has_run(ws_tokens(c)).alias("repeticao"))


def all_equal(*columns: Column) -> Column:
    return F.size(F.array_distinct(F.array(*columns))) == 1
