"""Relational operators of the companion service: users, niches, generations, feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from ..sources.transactions import TableSet
from .stats import month_counts, top_rows


def lookup(df: DataFrame, dimension: DataFrame, on: Sequence[str], name: str, default: str) -> DataFrame:
    """Left join of a dimension's ``name``, ``default`` where it has none."""
    return df.join(dimension.select(*on, name), list(on), "left").withColumn(name, F.coalesce(name, F.lit(default)))


def zero_filled(dimension: DataFrame, counts: DataFrame, on: Sequence[str], n: str = "n") -> DataFrame:
    return dimension.join(counts, list(on), "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last version of each key: a batch upsert."""
    return top_rows(df, keys, order, 1)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces rows of ``old`` with its keys; a null in ``new`` keeps the old value."""
    o, n = old.alias("o"), new.alias("n")
    rest = [c for c in old.columns if c not in keys]
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return o.join(n, on, "full").select(*[value(c).alias(c) for c in [*keys, *rest]])


def soft_delete(users: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Marks users as deleted and releases their e-mail address."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone") & F.col("deleted_at").isNull()
    stamp = F.unix_millis(at).cast("string")
    marked = users.join(gone, "id", "left")
    return marked.withColumns({"email": F.when(hit, F.concat("email", F.lit("+deleted_"), stamp)).otherwise(F.col("email")), "deleted_at": F.when(hit, at).otherwise(F.col("deleted_at"))}).drop("_gone")


def purge(rows: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """Rows whose ``owner`` is none of ``owners``: what is left when their owners are deleted."""
    return rows.join(owners.select(owner).distinct(), owner, "left_anti")


def sorted_by(df: DataFrame, key: str, keys: dict[str, Column], descending: bool = False, tie: str | None = None) -> DataFrame:
    """``df`` in the order of one of the named ``keys`` (a collated column sorts as readers of its language expect); an unknown key is an error."""
    order = keys[key].desc_nulls_last() if descending else keys[key].asc_nulls_last()
    return df.orderBy(order, *([tie] if tie else []))


def link_niches(links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links after adding those that are new, and the conflicts."""
    keys = ["user_id", "niche_id"]
    fresh = new.dropDuplicates(keys).join(links, keys, "left_anti")
    return links.unionByName(fresh, allowMissingColumns=True), new.join(links, keys, "left_semi")


def unlink_niches(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links without ``gone``, but a user whose last link would go keeps all of them."""
    keys = ["user_id", "niche_id"]
    marked = links.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), keys, "left")
    left = marked.groupBy("user_id").agg(F.count_if(F.col("_gone").isNull()).alias("_left"))
    return marked.join(left, "user_id").where(F.col("_gone").isNull() | (F.col("_left") == 0)).drop("_gone", "_left").select(*links.columns)


def feedback_stats(feedback: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, useful count and rounded percentage for STRUCTURE and SCRIPT feedback side by side."""
    aggs = []
    for kind in ("STRUCTURE", "SCRIPT"):
        own, useful = F.col("type") == kind, (F.col("type") == kind) & F.col("is_useful")
        pct = F.when(F.count_if(own) == 0, 0.0).otherwise(F.round(100.0 * F.try_divide(F.count_if(useful), F.count_if(own))))
        aggs += [F.count_if(own).alias(f"{kind.lower()}_count"), F.count_if(useful).alias(f"{kind.lower()}_useful"), pct.cast("long").alias(f"{kind.lower()}_percent")]
    return feedback.groupBy(*by).agg(*aggs)


def totals_and_groups(df: DataFrame, key: str) -> DataFrame:
    """Group counts and the total in one snapshot (the total's key is null)."""
    return df.rollup(key).agg(F.count("*").alias("n"))


def infer(requests: DataFrame, patterns: DataFrame, nearest: DataFrame) -> DataFrame:
    """Pattern of the requested niche, else of its nearest niche, else none: (niche, resolved, fallback_used)."""
    asked = requests.withColumn("niche", F.lower(F.trim("niche")))
    direct = patterns.select(F.col("nicho").alias("niche"), F.col("nicho").alias("_direct"))
    out = asked.join(direct, "niche", "left").join(nearest.select("niche", F.col("nearest").alias("_near")), "niche", "left")
    return out.withColumns({"resolved": F.coalesce("_direct", "_near"), "fallback_used": F.col("_direct").isNull() & F.col("_near").isNotNull()}).drop("_direct", "_near")


__all__ = ["feedback_stats", "infer", "latest", "link_niches", "lookup", "month_counts", "purge", "soft_delete", "sorted_by", "totals_and_groups", "unlink_niches", "upsert", "zero_filled"]


def registrations(users: DataFrame, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``batch`` (name, email, niche) with ``status``: ``conflict`` where the address is taken, ``duplicate`` where an earlier row has it, else ``registered``.

    Addresses are compared without case and outer blanks; a row without one is ``invalid``. ``order`` is total within an address.
    """
    key = F.lower(F.trim("email"))
    taken = users.select(key.alias("_email")).where("_email is not null").distinct().withColumn("_taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy("_email").orderBy(*order))
    rows = batch.withColumn("_email", key).withColumn("_first", first).join(taken, "_email", "left")
    status = F.when(F.coalesce("_email", F.lit("")) == "", "invalid").when(F.col("_taken"), "conflict").when(F.col("_first") > 1, "duplicate").otherwise("registered")
    return rows.withColumn("status", status).drop("_taken", "_first").withColumnRenamed("_email", "address")


def register(tables: TableSet, batch: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Register a batch in ``users``, ``niches`` and ``user_niches`` under one commit; the rows with their status.

    A niche that does not exist is made. Ids are digests of the address and the niche's name, so a repeated attempt makes the same rows.
    """
    last: list[DataFrame] = []
    digest = lambda c: F.md5(F.lower(F.trim(c)))

    def change(store: TableSet, base: int) -> dict:
        found = stored(registrations(store.read("users", base), batch, order), "registrations")
        last[:] = [found]
        fresh = found.where("status = 'registered'")
        known = store.read("niches", base).select(F.lower(F.trim("name")).alias("_name"))
        niches = fresh.where("niche is not null").select(F.lower(F.trim("niche")).alias("_name"), "niche").groupBy("_name").agg(F.min("niche").alias("name"))
        niches = niches.join(known, "_name", "left_anti").select(digest("name").alias("id"), "name")
        links = fresh.where("niche is not null").select(digest("address").alias("user_id"), digest("niche").alias("niche_id"))
        return {"append": {"users": fresh.select(digest("address").alias("id"), "name", F.col("address").alias("email")), "niches": niches, "user_niches": links}}

    tables.transact(change)
    return last[0]


def create_generations(tables: TableSet, requests: DataFrame) -> DataFrame:
    """Append the requests (user_id, niche_id, content) whose user has the niche to ``generations``; all requests with ``accepted``."""
    last: list[DataFrame] = []

    def change(store: TableSet, base: int) -> dict:
        own = store.read("user_niches", base).select("user_id", "niche_id").distinct().withColumn("_own", F.lit(True))
        found = stored(requests.join(own, ["user_id", "niche_id"], "left").withColumn("accepted", F.coalesce("_own", F.lit(False))).drop("_own"), "requests")
        last[:] = [found]
        return {"append": {"generations": found.where("accepted").drop("accepted")}}

    tables.transact(change)
    return last[0]
