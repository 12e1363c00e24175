"""Hard negatives by a vector-approximation file.

Rows and anchors are dealt into blocks and every block of anchors meets every block of rows in one
task. There the rows are a vector-approximation file: each dimension is quantised into cells that
hold about as many rows, a row is a few bytes of cell numbers, and tables of what a cell can add to
an anchor's score give a lower and an upper bound of it. Only rows that may still enter a window
are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, freeing_group, materialize

#: Cells of a dimension; two dimensions share a byte.
CELLS = 16
#: Rows in a block (between these, by the size of the table), anchors in a block, anchors whose bounds are held at once.
LEAST_ROWS, MOST_ROWS, ANCHORS, AT_ONCE = 4096, 65_536, 16_384, 16


class Approximation:
    """A block of integer vectors with the cells of each dimension; two dimensions share a code."""

    def __init__(self, x: np.ndarray):
        n, dims = x.shape
        self.x = x
        edges = np.sort(x, 0)[[n * k // CELLS for k in range(1, CELLS)]]
        cell = np.stack([np.searchsorted(edges[:, j], x[:, j], side="right") for j in range(dims)], 1)
        big = np.iinfo(np.int64).max
        self.low, self.high = np.full((dims, CELLS), big), np.full((dims, CELLS), -big)
        place = np.broadcast_to(np.arange(dims), cell.shape)
        np.minimum.at(self.low, (place, cell), x)
        np.maximum.at(self.high, (place, cell), x)
        empty = self.low > self.high
        self.low[empty], self.high[empty] = 0, 0
        if dims % 2:
            cell = np.concatenate([cell, np.zeros((n, 1), cell.dtype)], 1)
        self.codes = np.ascontiguousarray((cell[:, ::2] * CELLS + cell[:, 1::2]).T.astype(np.uint8))

    def _tables(self, parts: np.ndarray) -> np.ndarray:
        """What each code adds: (anchors, pairs of dimensions, codes)."""
        if parts.shape[1] % 2:
            parts = np.concatenate([parts, np.zeros_like(parts[:, :1])], 1)
        return (parts[:, ::2, :, None] + parts[:, 1::2, None, :]).reshape(len(parts), -1, CELLS * CELLS)

    def bounds(self, q: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of each row of ``q`` with the vectors in ``rows``."""
        a, b = q[:, :, None] * self.low[None], q[:, :, None] * self.high[None]
        out = []
        for parts in (np.minimum(a, b), np.maximum(a, b)):
            tables, total = self._tables(parts), np.zeros((len(q), rows.stop - rows.start), np.int64)
            for p, codes in enumerate(self.codes):
                total += np.take(tables[:, p], codes[rows], axis=1)
            out.append(total)
        return out[0], out[1]


def best_in_window(block: Approximation, q: np.ndarray, rows: np.ndarray, lower: np.ndarray, upper: np.ndarray, least: int, most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``rows`` those that may be among the ``k`` largest products within ``least`` .. ``most`` (ties kept), and their products.

    The bounds leave rows out whose product lies outside the window or below that of ``k`` rows which are in it for sure.
    """
    maybe = (upper >= least) & (lower <= most)
    sure = np.sort(lower[maybe & (lower >= least) & (upper <= most)])[-k:]
    if len(sure) == k:
        maybe &= upper >= sure[0]
    found = rows[maybe]
    score = block.x[found] @ q
    inside = (score >= least) & (score <= most)
    found, score = found[inside], score[inside]
    if len(score) > k:
        lead = score >= np.partition(score, len(score) - k)[len(score) - k]
        found, score = found[lead], score[lead]
    return found, score


def _vectors(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


class Block:
    """The entries of a task's group, sorted by label."""

    def __init__(self, table: pa.Table):
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.file = Approximation(_vectors(table.column("v"), len(table))[order])
        ids = table.column("ids").combine_chunks()
        starts, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()
        self.ids = [flat[starts[i] : starts[i + 1]] for i in order]

    def of_label(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, side="right")))

    def leading(self, rows: np.ndarray, score: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``k`` ids of entries by score, then id, without the id ``but``."""
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.concatenate([self.ids[r] for r in rows])
        score = np.repeat(score, [len(self.ids[r]) for r in rows])
        ids, score = ids[ids != but], score[ids != but]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]


def integer_rows(vectors: DataFrame, relabel_every: int, labels: int) -> DataFrame:
    """(vec_id, label, v array<int>) of the rows that take part."""
    y = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), y.alias("y"))
    rows = rows.where("vec_id is not null and label is not null and y is not null").where(F.coalesce(F.forall("y", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    size = rows.groupBy(F.size("y").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = size[0] if size else 0
    most = min(2.0**31 - 1, float(int(((1 << 63) / max(1, dims)) ** 0.5)) - 2)
    rows = rows.where((F.size("y") == dims) & (F.size("y") > 0) & F.forall("y", lambda x: F.abs(x) < most))
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("y", lambda x: F.floor(x).cast("int")).alias("v")).distinct()


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of a table (vec_id, label, embedding).

    Components become floor(256 x), a score is the integer product with the anchor; a row whose vec_id
    ``relabel_every`` divides first takes the next of ``labels`` labels. Anchors are rows whose vec_id
    ``anchor_every`` divides, their positives the first ``positives`` other rows of their label. For each positive come the
    first ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    First is the larger score, of equal ones the smaller vec_id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do
    those of another length than the commonest or with components whose products need more than a
    long. A repeated row counts once; rows of one id with other contents are rows of their own, but no partner of
    each other. Extra columns are ignored, an empty table gives no rows.

    Equal (label, vector) rows are one entry with as many of their smallest ids as a result can hold, so a
    vector that many rows share costs nothing. Every anchor meets every block, so the work is anchors times
    rows; a block pair returns at most its ``positives`` or ``negatives`` best for an anchor and window.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(integer_rows(vectors, relabel_every, labels), "rows")
    keep = max(positives, negatives) + 1
    place = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    members = rows.withColumn("place", place).where(F.col("place") <= keep)
    entries = materialize(members.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], result)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0).select(F.xxhash64("vec_id", "label", "v").alias("key"), F.col("vec_id").alias("anchor_id"), "label", "v")
    size = max(LEAST_ROWS, min(MOST_ROWS, total // 64))
    nv, nq = -(-total // size), -(-max(1, anchors.count()) // ANCHORS)
    dealt = entries.withColumns({"bv": F.pmod(F.xxhash64("label", "v"), F.lit(nv)).cast("int"), "bq": F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))})

    def asked(a: DataFrame) -> DataFrame:
        return a.withColumns({"bq": F.pmod("key", F.lit(nq)).cast("int"), "bv": F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))}).groupBy("bv", "bq")

    @freeing_pair
    def nearest(own: pa.Table, ask: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(ask):
            block, q, label = Block(own), _vectors(ask.column("v"), len(ask)), ask.column("label").to_numpy()
            ids = ask.column("anchor_id").to_numpy()
            every = np.iinfo(np.int64).max
            for value in np.unique(label):
                part, mine = block.of_label(value), np.flatnonzero(label == value)
                if part.start == part.stop:
                    continue
                span = np.arange(part.start, part.stop)
                for a in range(0, len(mine), AT_ONCE):
                    some = mine[a : a + AT_ONCE]
                    for i, lower, upper in zip(some, *block.file.bounds(q[some], part), strict=True):
                        found = best_in_window(block.file, q[i], span, lower, upper, -every, every, positives + 1)  # the anchor's own row may be one
                        best, score = block.leading(*found, positives, ids[i])
                        out.append((np.full(len(best), i), best, score))
        at, best, score = map(_joined, zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"key": ask.column("key").take(at), "positive_id": best, "score": score})

    near = dealt.groupBy("bv", "bq").cogroup(asked(anchors)).applyInArrow(nearest, "key long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "positive_id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    near = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p"))
    ready = materialize(anchors.join(near, "key").select("key", "anchor_id", "label", "v", F.col("p.positive_id").alias("positive_id"), F.col("p.score").alias("score")), "anchors")

    @freeing_pair
    def windows(own: pa.Table, ask: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(ask):
            block, q, label = Block(own), _vectors(ask.column("v"), len(ask)), ask.column("label").to_numpy()
            ids, scores = ask.column("anchor_id").to_numpy(), ask.column("score").to_pylist()
            rows = np.arange(len(own))
            for a in range(0, len(q), AT_ONCE):
                for i, lower, upper in zip(range(a, len(q)), *block.file.bounds(q[a : a + AT_ONCE], slice(0, len(own))), strict=False):
                    part = block.of_label(label[i])
                    other = np.concatenate([rows[: part.start], rows[part.stop :]])
                    lower, upper = lower[other], upper[other]
                    for place, positive in enumerate(scores[i]):
                        found = best_in_window(block.file, q[i], other, lower, upper, -(-low * positive // 100), high * positive // 100, negatives)
                        best, score = block.leading(*found, negatives, ids[i])
                        out.append((np.full(len(best), i), np.full(len(best), place), best, score))
        at, place, best, score = map(_joined, zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"key": ask.column("key").take(at), "place": place, "negative_id": best, "negative_score": score})

    found = dealt.groupBy("bv", "bq").cogroup(asked(ready)).applyInArrow(windows, "key long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = materialize(found.withColumn("rank", rank).where(F.col("rank") <= negatives), "found")
    at = F.col("place").cast("int") + 1
    out = found.join(ready.select("key", "anchor_id", "positive_id", "score"), "key")
    out = out.select("anchor_id", F.element_at("positive_id", at).alias("positive_id"), "rank", "negative_id", F.element_at("score", at).alias("positive_score"), "negative_score")
    for used in (rows, entries):
        discard(used)
    return out


def _joined(parts: tuple) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64)


def freeing_pair(run):
    """``freeing_group`` for a function over two groups."""
    one = freeing_group(lambda pair: run(*pair))

    def both(own: pa.Table, ask: pa.Table) -> pa.Table:
        return one((own, ask))

    return both


def oracle() -> str:
    """DuckDB SQL of ``hard_negatives`` over ``embeddings``."""
    return """WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
