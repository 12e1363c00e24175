"""Spelling variants: words of a corpus one edit apart, and the commoner form that each one stands for.

The parities of a word's letter counts are a bit mask in which one edit flips at most two bits. The
mask is split into three bands, so two words one edit apart have an equal band. Words meet where a
band, the length and an unedited half of the word are equal; what meets is verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Shortest word in code points, fewest occurrences, divisor of the hashes that lose a letter, and how many times commoner a form is.
LEAST_LENGTH, LEAST_COUNT, DROP_EVERY, COMMONER = 7, 2, 31, 10
BANDS = 3
#: Letters of the words: a to z and U+00C0 to U+00FF.
LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A to Z in lower case and nothing else; plain ASCII takes the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): runs of letters with their counts, after the seeded loss of one letter.

    A shorter run cannot give a word, so it is not looked at. The counts are summed before the shuffle,
    so a word that holds a third of all occurrences costs one row a task.
    """
    runs = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), runs.alias("_run")).select("_doc", lower_ascii(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat_ws(":", "_doc", "_run"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    lost = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % drop_every == 0, lost).otherwise(F.col("_run"))
    words = rows.withColumn("_h", h).select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column, bits: dict[int, int]) -> Column:
    """The parities of the letters in ``bits`` (code point to bit) as a long."""
    table = F.array(*[F.lit(1 << bits[c] if c in bits else 0).cast("long") for c in range(256)])
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.when(c == "", 0).otherwise(F.element_at(table, F.ascii(c) + 1)).cast("long")))


def balanced_bands(words: DataFrame, bands: int = BANDS) -> list[dict[int, int]]:
    """The letters dealt into ``bands`` bands so that the bands tell words apart about equally well.

    A letter weighs what its parity tells over all words; the heaviest goes to the lightest band.
    Only one number for each letter comes to the driver.
    """
    odd = lambda c: F.avg(((F.char_length("word") - F.char_length(F.replace("word", F.lit(chr(c)), F.lit("")))) % 2).cast("double"))
    shares = words.agg(*[odd(c).alias(str(c)) for c in LETTERS]).first()
    weight = {c: 4 * (p := shares[str(c)] or 0.0) * (1 - p) for c in LETTERS}
    out: list[dict[int, int]] = [{} for _ in range(bands)]
    load = [0.0] * bands
    most = -(-len(LETTERS) // bands)
    for c in sorted(LETTERS, key=lambda c: (-weight[c], c)):
        k = min((k for k in range(bands) if len(out[k]) < most), key=lambda k: (load[k], k))
        out[k][c] = len(out[k])
        load[k] += weight[c]
    return out


def near_words(words: DataFrame, bands: list[dict[int, int]]) -> DataFrame:
    """(a, n_a, b, n_b): every two words one edit apart, once; the shorter is a, of equal lengths the smaller.

    One edit leaves the first floor(L / 2) or the last ceil(L / 2) letters as they are, L being the shorter
    length. So words meet on a band, L and one of these halves; a longer word meets the shorter ones under
    L = its length less one. That keeps meetings small where a band has few values. A large meeting
    is a skewed join, which adaptive execution cuts. A pair counts at its first half and band only.
    """
    rows = materialize(words.select("word", "n", *[parity_mask(F.col("word"), b).alias(f"m{k}") for k, b in enumerate(bands)]), "masks")
    masks = [F.col(f"m{k}") for k in range(len(bands))]

    def meeting(size: Column) -> Column:
        """An entry for each half and band, the length being ``size``."""
        half = F.floor(size / 2).cast("int")
        halves = [F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.char_length("word") - (size - half) + 1, size - half)]
        return F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("band"), F.xxhash64(F.lit(s), F.lit(k), size, m, t).alias("key")) for s, t in enumerate(halves) for k, m in enumerate(masks)])

    def side(entries: Column, name: str) -> DataFrame:
        plain = rows.select(F.inline(entries), "word", "n", *masks)
        return plain.select("key", "side", "band", *[F.col(c).alias(f"{name}_{c}") for c in ("word", "n", *[f"m{k}" for k in range(len(bands))])])

    own, longer = meeting(F.char_length("word")), meeting(F.char_length("word") - 1)
    a, b = side(own, "a"), side(F.concat(own, longer), "b")
    size_a, size_b = F.char_length("a_word"), F.char_length("b_word")
    flips = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_m{k}").bitwiseXOR(F.col(f"b_m{k}"))) for k in range(len(bands))])
    first_band = reduce(lambda x, y: x & y, [(F.col("band") <= k) | (F.col(f"a_m{k}") != F.col(f"b_m{k}")) for k in range(len(bands))])
    half = F.floor(size_a / 2).cast("int")
    first_side = (F.col("side") == 0) | (F.substring("a_word", F.lit(1), half) != F.substring("b_word", F.lit(1), half))
    lengths = ((size_b == size_a) & (F.col("a_word") < F.col("b_word"))) | (size_b == size_a + 1)
    near = a.join(b, ["key", "side", "band"]).where((flips <= 2) & lengths & first_band & first_side & (F.levenshtein("a_word", "b_word", 1) == 1))
    return near.select(F.col("a_word").alias("a"), F.col("a_n").alias("n_a"), F.col("b_word").alias("b"), F.col("b_n").alias("n_b"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the forms followed to the last one.

    Counts grow tenfold with each step, so there are at most 18 of them; a step moves only the words whose
    root has a form itself.
    """
    now, done = materialize(forms.select("word", F.col("form").alias("root")), "roots"), None
    links = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
    while True:
        moved = now.join(links, "root").select("word", F.col("_next").alias("root"))
        ended = now.join(links, "root", "left_anti")
        done = ended if done is None else done.unionByName(ended)
        now = materialize(moved, "roots")
        if now.isEmpty():
            discard(now)
            return done


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY, commoner: int = COMMONER) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs`` (doc_id, text).

    Words are runs of letters, A to Z in lower case, of at least ``least_length`` code points and
    ``least_count`` occurrences; a run whose hash with the document's id ``drop_every`` divides loses one
    letter first. ``n_near`` counts the words one edit away; ``form`` is the commonest of them (ties: the
    smallest) if it is ``commoner`` times as common, else null; ``root`` follows the forms to the last.

    A null text has no words, a null id is hashed as an empty one, a repeated row counts again, texts
    are taken whole whatever their length, further columns are ignored, an empty table gives no rows.
    """
    words = materialize(word_counts(docs, least_length, least_count, drop_every), "words")
    near = near_words(words, balanced_bands(words))
    both = near.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("n_b").alias("n"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("n_a").alias("n"), F.col("a").alias("other")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("_best"))
    best = best.select("word", "n_near", (-F.col("_best.less")).alias("_n"), F.col("_best.other").alias("_form"))
    fit = F.col("_n") >= commoner * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fit, F.col("_form")).alias("form"), F.when(fit, F.col("_n")).alias("form_n"))
    found = materialize(found, "variants")
    discard(words)
    roots = roots_of(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def oracle() -> str:
    """DuckDB SQL of ``spelling_variants`` over ``documents``. Its edit distance is one of bytes, so letters become single bytes."""
    accents = "".join(map(chr, range(0xC0, 0x100)))
    single = "".join(chr(c) for c in range(33, 127) if not 97 <= c <= 122 and chr(c) not in "'\\")[:64]
    table = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))"
    return f"""WITH RECURSIVE crc AS MATERIALIZED ({table}),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS r FROM documents),
seen AS (SELECT d, r, count(*) AS k FROM runs WHERE length(r) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT r, k, xor(list_reduce([4294967295] || list_transform(range(strlen(d || ':' || r)), lambda i: ('0x' || substr(hex(encode(d || ':' || r)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM seen, crc),
lost AS (SELECT k, CASE WHEN h % {DROP_EVERY} = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n, translate(word, '{accents}', '{single}') AS flat, length(word) AS size FROM lost WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
near AS (SELECT a.word, b.word AS other, b.n FROM w a JOIN w b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.flat, b.flat) = 1),
best AS (SELECT word, count(*)::BIGINT AS n_near, min({{'less': -n, 'form': other}}) AS b FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= {COMMONER} * w.n THEN b.form END AS form, CASE WHEN -b.less >= {COMMONER} * w.n THEN (-b.less)::BIGINT END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.nxt)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN walk ON walk.word = f.word AND walk.nxt IS NULL"""
