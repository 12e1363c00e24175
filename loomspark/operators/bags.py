"""Term bags: explode, count, rank, co-occurrence; TF-IDF in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.positional import ngram_rows
from ..session import dealt
from .stats import top_rows, with_groups


#: Cells that rare terms are told from common ones by, and the part of the rows (one in so many) that the first guess comes from.
CELLS, PART = 1 << 20, 32
#: Tasks a core, at most, that count cells.
CELL_TASKS = 2


def exploded(df: DataFrame, terms: Column, keys: Sequence[str], name: str = "term") -> DataFrame:
    return df.select(*keys, F.explode(terms).alias(name))


def term_counts(df: DataFrame, terms: Column, by: Sequence[str]) -> DataFrame:
    return exploded(df, terms, by).groupBy(*by, "term").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, terms: Column, by: Sequence[str], k: int) -> DataFrame:
    """The ``k`` commonest terms of each group, ties in the order of the term."""
    return top_rows(term_counts(df, terms, by), by, [F.desc("n"), F.asc("term")], k, rank="rank")


def top_counts(terms: DataFrame, by: Sequence[str], k: int, columns: Sequence[str] = ("term",)) -> DataFrame:
    """The ``k`` commonest rows of ``columns`` in each group of an exploded table, with ``n`` and ``rank``."""
    counts = terms.groupBy(*by, *columns).agg(F.count("*").alias("n"))
    order = [F.desc("n"), *map(F.asc, columns)]
    return top_rows(counts if by else counts.orderBy(*order).limit(k), by, order, k, rank="rank")


def top_counts_of_rows(terms: DataFrame, row: str, by: Sequence[str], k: int, columns: Sequence[str] = ("term",), groups: DataFrame | None = None, hashes: int = 1) -> DataFrame:
    """``top_counts`` of a large exploded table (row, by, columns) of mostly rare rows, which are not shuffled; exact.

    The terms that are commonest in a part of the rows are counted in all of them: the k-th of a group is
    a count that its k commonest terms reach. All terms are then counted in ``CELLS`` cells by hash. A cell below that count holds
    none of them, so only terms of fuller cells are counted one by one. The guess decides how much is left out early, never what
    is found: a group with too few guesses is counted whole. ``groups``: the distinct values of ``by``, if they are cheaper to get elsewhere.
    ``hashes``: with two (``by`` is needed) each term is counted in a second cell too, of those that only its group has, and both
    must be full: so common terms of small groups are told from rare ones of large groups.
    """
    keys = [*by, *columns]
    cells_of = [F.pmod(F.xxhash64(F.lit(0), *keys), F.lit(CELLS))]
    part = terms.where(F.pmod(F.xxhash64(F.lit(PART), row), F.lit(PART)) == 0)
    if hashes > 1:  # a single row of one repeated term must not fill the guess: of four parts the one with most of a term is left out
        fourth = F.pmod(F.xxhash64(F.lit(4), row), F.lit(4))
        parts = part.groupBy(*keys).agg(*[F.count_if(fourth == i).alias(f"_part{i}") for i in range(4)])
        score = sum((F.col(f"_part{i}") for i in range(4)), F.lit(0)) - F.greatest(*[f"_part{i}" for i in range(4)])
        guess = top_rows(parts.select(*keys, score.alias("n")), by, [F.desc("n"), *map(F.asc, columns)], 2 * k)
    else:
        guess = top_counts(part, by, 2 * k, columns)
    guess = F.broadcast(guess.select(*keys))  # at most 2 k for each group
    exact = top_counts(with_groups(terms, guess, keys), by, k, columns)
    floors = exact.where(F.col("rank") == k).select(*by, F.col("n").alias("_floor"))
    least = floors.agg(F.max("_floor").alias("_least"))
    if by:
        groups = terms.select(*by).distinct() if groups is None else groups
        least = with_groups(groups, F.broadcast(floors), by, "left").agg(F.min(F.coalesce("_floor", F.lit(0))).alias("_least"))
    if hashes > 1:
        slots = groups.select(*by, (F.row_number().over(Window.orderBy(*by)) - 1).alias("_slot"), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.count("*").over(Window.partitionBy(F.lit(0))))).alias("_width"))
        terms = with_groups(terms, F.broadcast(slots), by)  # one row a group
        cells_of.append(CELLS + F.pmod(F.col("_slot") * F.col("_width") + F.pmod(F.xxhash64(F.lit(1), *keys), F.col("_width")), F.lit(CELLS)))
    # A task gives a row for each cell, so few tasks count them: their number, and the rows, do not grow with the input.
    few = terms.coalesce(CELL_TASKS * terms.sparkSession.sparkContext.defaultParallelism)
    cells = few.select(F.explode(F.array(*cells_of)).alias("_cell") if hashes > 1 else cells_of[0].alias("_cell")).groupBy("_cell").agg(F.count("*").alias("_all"))
    full = cells.crossJoin(F.broadcast(least)).where(F.col("_all") >= F.coalesce("_least", F.lit(0))).select(F.col("_cell").alias("_full"), "_all")
    left = terms.select(*keys, *[c.alias(f"_cell{i}") for i, c in enumerate(cells_of)])
    for i in range(hashes):
        left = left.join(F.broadcast(full.select(F.col("_full").alias(f"_full{i}"), F.col("_all").alias(f"_all{i}"))), F.col(f"_cell{i}") == F.col(f"_full{i}"))
    left = left.withColumn("_all", F.least("_all0", "_all1") if hashes == 2 else F.col("_all0"))
    if by:
        left = with_groups(left, F.broadcast(floors), by, "left").where(F.col("_all") >= F.coalesce("_floor", F.lit(0)))
    return top_counts(left, by, k, columns)


def filtered_bag(df: DataFrame, terms: Column, keep: Column, by: Sequence[str], k: int) -> DataFrame:
    """Top terms of the rows that ``keep``; a group with fewer than ``k`` of them adds its counts over all rows."""
    both = df.select(*by, keep.alias("_keep"), F.explode(terms).alias("term")).groupBy(*by, "term").agg(F.count_if("_keep").alias("inner"), F.count("*").alias("whole"))
    some = both.groupBy(*by).agg(F.count_if(F.col("inner") > 0).alias("distinct_inner"))
    joined = with_groups(both, some, by)
    n = F.when(F.col("distinct_inner") < k, F.col("inner") + F.col("whole")).otherwise(F.col("inner"))
    return top_rows(joined.withColumn("n", n).where("n > 0").select(*by, "term", "n"), by, [F.desc("n"), F.asc("term")], k, rank="rank")


def dispersion(df: DataFrame, terms: Column, row: str, by: Sequence[str], k: int) -> DataFrame:
    """Occurrences and number of rows of the commonest terms."""
    per_row = df.select(row, *by, F.explode(terms).alias("term")).groupBy(row, *by, "term").agg(F.count("*").alias("c"))
    both = per_row.groupBy(*by, "term").agg(F.sum("c").alias("n"), F.count("*").alias("rows"))
    return top_rows(both, by, [F.desc("n"), F.asc("term")], k, rank="rank")


def exclusive_terms(df: DataFrame, terms: Column, side: Column, k: int) -> DataFrame:
    """Commonest terms of rows where ``side`` is true that never occur where it is false."""
    counts = df.select(side.alias("_side"), F.explode(terms).alias("term")).groupBy("term").agg(F.count_if("_side").alias("n"), F.count_if(~F.col("_side")).alias("other"))
    return counts.where("n > 0 and other = 0").select("term", "n").orderBy(F.desc("n"), "term").limit(k)


def pair_counts(df: DataFrame, items: Column, k: int) -> DataFrame:
    """Commonest unordered pairs of distinct items in a row's (short) item set."""
    own = F.array_sort(F.array_distinct(items))
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.greatest(F.size(own), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)


def cooccurrence(df: DataFrame, terms: Column, by: Sequence[str], k: int = 10) -> DataFrame:
    """Rows in which two of a group's ``k`` commonest terms occur together.

    A row's terms are first cut down to the top terms (k for each group), so pairs stay few per row.
    """
    top = top_terms(df, terms, by, k).groupBy(*by).agg(F.collect_set("term").alias("_top"))
    rows = with_groups(df.select(*by, terms.alias("_terms")), F.broadcast(top), by)  # one row a group; texts stay where they are
    own = rows.select(*by, F.array_sort(F.array_intersect(F.array_distinct("_terms"), "_top")).alias("_own"))
    pairs = F.flatten(F.transform("_own", lambda a, i: F.transform(F.slice("_own", i + 2, F.lit(k)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return own.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.a", "p.b").agg(F.count("*").alias("n"))


def tfidf_of(rows: DataFrame, row: str, n_rows: DataFrame | None = None, sublinear: bool = False, features: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(row, keep, term, tf, score) of an exploded table (row, keep, term) that is dealt out by ``row``.

    idf = ln((1 + n) / (1 + df)) + 1, rows scaled to unit length. ``features`` keeps the terms that are
    commonest in all rows (ties: in the order of the term); so many are broadcast, terms are counted by row only if they are among
    them, and a row's terms never leave its task. Without it the whole vocabulary is joined by term. ``n_rows`` is a table of one number, by default the rows that have terms.
    """
    tf = lambda terms: terms.groupBy(row, *keep, "term").agg(F.count("*").alias("tf"))
    if features:
        counted = tf(rows.join(F.broadcast(common_terms(rows, row, features)), "term"))
    else:
        counted = tf(rows)
    n_rows = (rows.agg(F.count_distinct(row)) if n_rows is None else n_rows).toDF("_rows")
    words = counted.groupBy("term").agg(F.count("*").alias("_df"))
    idf = words.crossJoin(F.broadcast(n_rows)).select("term", (F.log((1.0 + F.col("_rows")) / (1.0 + F.col("_df"))) + 1).alias("_idf"))
    weight = (1 + F.log("tf")) if sublinear else F.col("tf")
    raw = counted.join(F.broadcast(idf) if features else idf, "term").withColumn("_w", weight * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(row)))
    return raw.select(row, *keep, "term", "tf", (F.col("_w") / norm).alias("score"))


def common_terms(rows: DataFrame, row: str, k: int) -> DataFrame:
    """(term): the ``k`` commonest terms of an exploded table (row, term), ties in the order of the term."""
    return top_counts_of_rows(rows, row, [], k).select("term")


def tfidf(df: DataFrame, terms: Column, row: str, sublinear: bool = False, features: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(row, keep, term, tf, score) of a table with one row for each ``row``; see ``tfidf_of``. The texts are shuffled once, their terms never."""
    return tfidf_of(dealt(df, row).select(row, *keep, F.explode(terms).alias("term")), row, row_count(df), sublinear, features, keep)


def row_count(df: DataFrame) -> DataFrame:
    """The number of rows as a table, so that nothing runs while a plan is made."""
    return df.agg(F.count("*").alias("_rows"))


def mean_tfidf(scores: DataFrame, n_rows: DataFrame) -> DataFrame:
    """(term, mean_score) over all rows, those without the term included; ``n_rows`` is a table of one number."""
    sums = scores.groupBy("term").agg(F.sum("score").alias("_sum"))
    return sums.crossJoin(F.broadcast(n_rows.toDF("_rows"))).select("term", (F.col("_sum") / F.col("_rows")).alias("mean_score"))


def similarity_to_mean(df: DataFrame, terms: Column, row: str, features: int) -> DataFrame:
    """(row, sim): the cosine of each row's TF-IDF vector and the mean vector of all rows; rows without a term are left out.

    The mean is a sparse vector of at most ``features`` terms, so it is broadcast and a row's terms stay in their task.
    """
    scores = tfidf(df, terms, row, features=features)
    mean = mean_tfidf(scores, row_count(df))
    size = mean.agg(F.sqrt(F.sum(F.col("mean_score") * F.col("mean_score"))).alias("_size"))
    near = scores.join(F.broadcast(mean), "term").groupBy(row).agg(F.sum(F.col("score") * F.col("mean_score")).alias("_dot"))
    return near.crossJoin(F.broadcast(size)).select(row, F.try_divide(F.col("_dot"), F.col("_size")).alias("sim"))


def ngram_tfidf(df: DataFrame, toks: Column, row: str, sizes: Sequence[int], features: int, k: int, sublinear: bool = False) -> DataFrame:
    """(term, mean_score): the ``k`` n-grams of the given sizes with the largest mean TF-IDF."""
    rows = ngram_rows(dealt(df, row), toks, [row], sizes)
    return mean_tfidf(tfidf_of(rows, row, row_count(df), sublinear, features), row_count(df)).orderBy(F.desc("mean_score"), "term").limit(k)


def contrast(df: DataFrame, terms: Column, row: str, side: Column, k: int | None = None, features: int | None = None, sublinear: bool = False) -> DataFrame:
    """(term, diff): mean TF-IDF of the rows where ``side`` is true less that of the rows where it is false.

    Fitted on both kinds of rows together; a null ``side`` is neither. ``k``: so many terms each way.
    """
    rows = df.withColumn("_side", side).where("_side is not null")
    sizes = rows.agg(F.greatest(F.count_if("_side"), F.lit(1)).alias("_own"), F.greatest(F.count_if(~F.col("_side")), F.lit(1)).alias("_others"))
    scores = tfidf(rows, terms, row, sublinear, features, keep=["_side"])
    part = lambda own: F.coalesce(F.sum(F.when(own, F.col("score"))), F.lit(0.0))
    out = scores.groupBy("term").agg(part(F.col("_side")).alias("_a"), part(~F.col("_side")).alias("_b"), F.count("*").alias("rows"))
    out = out.crossJoin(F.broadcast(sizes)).select("term", (F.col("_a") / F.col("_own") - F.col("_b") / F.col("_others")).alias("diff"), "rows")
    if k is None:
        return out
    return out.orderBy(F.desc("diff"), "term").limit(k).unionByName(out.orderBy("diff", "term").limit(k)).distinct()
