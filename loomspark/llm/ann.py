"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are grouped into the lists of a coarse k-means index that is fitted on a bounded sample and
holds every vector. A query probes the lists whose centres are nearest. In a list the vectors are
turned by a random rotation and kept in column blocks; after each block a hypothesis test compares
the distance seen so far, scaled to all dimensions, with the k-th best, and abandons candidates that
are farther with high confidence. What is left is ranked by the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Index: at most so many lists and so many sampled vectors for each; rows of vectors and of queries in a cell.
MAX_LISTS, SAMPLE_PER_LIST, CELL_ROWS, CELL_QUERIES = 4096, 48, 4096, 2048
BLOCK, EPSILON = 16, 2.1
#: The probes are as many as find this share of the true neighbours within the sample.
LEAST_PROBES, COVERED = 8, 0.98


@dataclass
class Index:
    centres: np.ndarray
    rotation: np.ndarray
    probes: int


def tame(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two so that the largest component is near 1: directions stay exactly, norms stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = tame(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_centres(x: np.ndarray, centres: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """For each row the centre with the largest product, ``chunk`` rows at a time."""
    return np.concatenate([np.zeros(0, np.int64), *[(x[a : a + chunk] @ centres.T).argmax(1) for a in range(0, len(x), chunk)]]).astype(np.int64)


def fit_index(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 11) -> Index:
    """Spherical k-means centres of ``sample`` and a random rotation."""
    rng = np.random.default_rng(seed)
    x = unit(sample).astype(np.float32)
    centres = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = nearest_centres(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    q, r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    # How far down a query's order of lists its nearest vectors of the sample lie.
    asked = rng.permutation(len(x))[:400]
    near = nearest_centres(x, centres)
    place = np.empty((len(asked), len(centres)), np.int64)
    np.put_along_axis(place, (-(x[asked] @ centres.T)).argsort(1, kind="stable"), np.arange(len(centres))[None, :], 1)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    best = score.argsort(1)[:, ::-1][:, :5]
    depth = np.sort(np.take_along_axis(place, near[best], 1).ravel())
    probes = int(depth[min(len(depth) - 1, int(COVERED * len(depth)))]) + 1
    return Index(centres, q * np.sign(np.diag(r)), min(len(centres), max(LEAST_PROBES, probes)))


def scan_list(base: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the rows of ``base`` that may be among its k nearest, after early abandoning.

    Squared distances of unit vectors stand for cosines. The first k rows give the first threshold;
    it is tightened by the partial order after each block.
    """
    x, q = unit(base) @ rotation, unit(queries) @ rotation
    dims = x.shape[1]
    blocks = [np.ascontiguousarray(x[:, a : a + BLOCK]) for a in range(0, dims, BLOCK)]
    out = []
    for v in q:
        alive = np.arange(len(x))
        seen = np.zeros(len(x))
        for i, block in enumerate(blocks):
            part = block[alive] if len(alive) < len(x) else block
            seen = seen + ((part - v[i * BLOCK : i * BLOCK + part.shape[1]]) ** 2).sum(1)
            done = min((i + 1) * BLOCK, dims)
            if len(alive) <= k or done == dims:
                continue
            lead = alive[np.argpartition(seen, k - 1)[:k]]  # exact distances of the k that lead so far
            limit = ((x[lead] - v) ** 2).sum(1).max()
            keep = seen * dims / done <= limit * (1 + EPSILON / np.sqrt(done)) ** 2
            keep |= np.isin(alive, lead)
            alive, seen = alive[keep], seen[keep]
        if len(alive) > k:
            edge = np.partition(seen, k - 1)[k - 1]
            alive = alive[seen <= edge * (1 + 1e-9) + 1e-12]  # ties stay
        out.append(alive)
    return out


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): rows with finite, non-zero vectors of the commonest length (ties: the longer)."""
    v = F.col("embedding").cast("array<double>")
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(finite & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row with ``vec_id % query_every = 0``.

    ``probes`` lists are searched for each query; None takes the number that the index was fitted with.

    Score is the cosine in double precision on the original vectors; ties go to the smaller vec_id,
    a query is no candidate of its own. Null, zero and non-finite vectors take no part, nor do those of
    another length than the commonest (they have no cosine with the rest), nor rows without an id.
    Huge and tiny vectors are scaled by powers of two, so only their direction counts. Equal vectors are
    one entry with their k + 1 smallest ids, so copies of one vector cost nothing. A repeated (vec_id,
    vector) counts once, an empty table gives no rows, extra columns are ignored.

    The index has at most ``MAX_LISTS`` lists and is fitted on the driver with a bounded sample; beyond
    ``MAX_LISTS`` squared vectors its lists grow, and with them the work of a query.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors)
    members = usable.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    entries = materialize(members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    total = entries.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    lists = int(min(MAX_LISTS, max(1, total**0.5)))
    share = min(1.0, 2.0 * SAMPLE_PER_LIST * lists / total)
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    taken = entries.withColumn("place", place).where(F.col("place") < share * float(1 << 30)).orderBy("place").limit(SAMPLE_PER_LIST * lists).select("v")
    sample = taken.toArrow().column("v").combine_chunks()  # at most SAMPLE_PER_LIST * MAX_LISTS vectors, as one array
    index = fit_index(np.asarray(sample.values).reshape(len(sample), -1), lists)
    shared = spark.sparkContext.broadcast(index)
    probes = probes or index.probes

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near = nearest_centres(unit(np.array(f.v.tolist())), shared.value.centres)
                yield f.assign(list=near.astype(np.int32))

    listed = materialize(entries.mapInPandas(assign, "v array<double>, ids array<long>, list int"), "listed")
    sizes = np.zeros(len(index.centres), np.int64)
    for r in listed.groupBy("list").agg(F.sum(F.size("ids"))).collect():  # one number for each of at most MAX_LISTS lists
        sizes[r[0]] = r[1]
    filled = spark.sparkContext.broadcast(sizes)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest lists of each query: ``probes`` of them, more if they hold too few vectors."""
        for f in frames:
            rows = []
            for a in range(0, len(f), 1024):
                part = f.iloc[a : a + 1024]
                order = (-(unit(np.array(part.v.tolist())) @ shared.value.centres.T)).argsort(1, kind="stable")
                for q, v, o in zip(part.query_id, part.v, order, strict=True):
                    o = o[filled.value[o] > 0]
                    enough = int(np.searchsorted(filled.value[o].cumsum(), k + 2)) + 1
                    rows += [(q, v, int(c)) for c in o[: max(probes, enough)]]
            yield pd.DataFrame(rows, columns=["query_id", "v", "list"])

    queries = usable.where(F.col("vec_id") % query_every == 0).distinct().select(F.col("vec_id").alias("query_id"), "v")
    probed = materialize(queries.mapInPandas(probe, "query_id long, v array<double>, list int"), "probed")
    # A list and its queries are cut into cells of bounded size; each query block meets each vector block.
    rows_of = {r[0]: r[1] for r in listed.groupBy("list").count().collect()}
    queries_of = {r[0]: r[1] for r in probed.groupBy("list").count().collect()}
    cut = [(c, -(-n // CELL_ROWS), -(-queries_of[c] // CELL_QUERIES)) for c, n in rows_of.items() if c in queries_of]
    cuts = F.broadcast(spark.createDataFrame(cut, "list int, nv int, nq int"))  # at most MAX_LISTS rows
    base = (
        listed.join(cuts, "list").withColumn("bv", F.pmod(F.xxhash64("v"), "nv").cast("int"))
        .withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("list", "bv", "bq", "v", "ids")
    )
    asked = (
        probed.join(cuts, "list").withColumn("bq", F.pmod(F.xxhash64("query_id"), "nq").cast("int"))
        .withColumn("bv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1))).select("list", "bv", "bq", "query_id", "v")
    )

    def scan(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(ask):
            x, q = tame(np.array(own.v.tolist())), tame(np.array(ask.v.tolist()))
            ids = own.ids.tolist()
            norms = np.sqrt((x * x).sum(1))
            # The query's own entry may hold no other id, so one entry more is kept.
            for query, v, kept in zip(ask.query_id, q, scan_list(x, q, shared.value.rotation, k + 1), strict=True):
                score = (x[kept] * v).sum(1) / (norms[kept] * np.sqrt((v * v).sum()))
                found = sorted((-s, i) for s, e in zip(score.tolist(), kept, strict=True) for i in ids[e] if i != query)[:k]
                rows += [(query, i, -s) for s, i in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = base.groupBy("list", "bv", "bq").cogroup(asked.groupBy("list", "bv", "bq")).applyInPandas(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
