"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are word sequences. Runs of ``SEED`` shared words, as short as the shortest
tile, are the seeds that a Spark join brings together. An item joins by its rarer seeds only: with the
commonest ones alone, too few of its words could be covered. A fixed-size bitmap of these seeds first drops the seeds of a document
that no item has, so only what is left is shuffled. Each joined pair of a document and an item is tiled:
of all unmarked common runs of at least ``TILE`` words, found by running Karp-Rabin hashes, the longest
are marked first and never overlap, until none is left. The share of the item's words under tiles flags
the document, in whatever order its passages stand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freeing, materialize, row_slices, text_buffers

TILE, COVER = 3, 0.6
SEED = TILE
#: Bits of the bitmap: so many for each seed of the benchmark, within these bounds (2^27 bits are 16 MB).
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 512, 1 << 20, 1 << 27
#: Items of one document that are tiled together; results that are broadcast at most (about 60 bytes each).
ITEMS_PER_SLICE, MOST_BROADCAST = 64, 200_000
#: Bytes of text whose seeds are worked out together (about 60 bytes of memory each); a longer text stands alone.
SLICE_BYTES = 1 << 18
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def words(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return raw.translate(_FOLD.tobytes()).split()


def tile(doc: list[int], item: list[int], least: int = TILE) -> int:
    """Words of ``item`` under a greedy string tiling with ``doc``; equal runs go to the leftmost places."""
    free_doc, free_item = [True] * len(doc), [True] * len(item)
    covered = 0
    while (length := _longest(doc, free_doc, item, free_item)) >= least:
        places: dict[int, list[int]] = defaultdict(list)
        for at, h in _rolling(doc, free_doc, length):
            places[h].append(at)
        for at, h in list(_rolling(item, free_item, length)):
            want = item[at : at + length]
            for spot in places.get(h, ()):
                if all(free_item[at : at + length]) and all(free_doc[spot : spot + length]) and doc[spot : spot + length] == want:
                    free_item[at : at + length] = [False] * length
                    free_doc[spot : spot + length] = [False] * length
                    covered += length
    return covered


def _rolling(seq: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """(start, running hash) of every run of ``n`` unmarked words."""
    top, h, have = pow(_BASE, n, 1 << 64), 0, 0
    for i, w in enumerate(seq):
        if not free[i]:
            h = have = 0
            continue
        h = (h * _BASE + w + 1) & _MASK
        have += 1
        if have > n:
            h = (h - (seq[i - n] + 1) * top) & _MASK
        if have >= n:
            yield i - n + 1, h


def _longest(doc: list[int], free_doc: list[bool], item: list[int], free_item: list[bool]) -> int:
    """Length of the longest common run of unmarked words."""
    where: dict[int, list[int]] = defaultdict(list)
    for j, w in enumerate(item):
        if free_item[j]:
            where[w].append(j)
    best, last = 0, {}
    for i, w in enumerate(doc):
        now: dict[int, int] = {}
        if free_doc[i]:
            for j in where.get(w, ()):
                now[j] = last.get(j - 1, 0) + 1
                best = max(best, now[j])
        last = now
    return best


def covered_share(doc: list[bytes], item: list[bytes]) -> float:
    """The share of the item's words under tiles; in a document a mark stands for each run of words that the item lacks."""
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    seq = np.fromiter(map(number.get, doc, repeat(0)), np.int64, len(doc))
    keep = seq > 0
    keep[1:] |= seq[:-1] > 0
    return tile(seq[keep].tolist(), [number[w] for w in item], min(TILE, len(item))) / len(item)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers


def seeds(raw: np.ndarray, offsets: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, seed hash) of every run of ``sizes`` words in the texts, and the number of words of each text."""
    n, rows = len(raw), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    folded = _FOLD[raw]
    solid = folded != 32
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | first[1:-1]]))
    ends = np.flatnonzero(solid & np.concatenate([~solid[1:] | first[1:-1], [True]])) + 1
    up, down = _power(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C2)
    row = np.searchsorted(offsets, starts, side="right") - 1
    found = []
    for k in sizes:
        if len(word) < k:
            continue
        h = np.full(len(word) - k + 1, k, np.uint64)
        for j in range(k):
            h = _mix(h * np.uint64(_BASE) + word[j : j + len(h)])
        same = row[: len(h)] == row[k - 1 :]
        found.append((row[: len(h)][same], h[same]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    at, h = (np.concatenate(x) for x in zip(none, *found, strict=True))
    return at, h, np.bincount(row, minlength=rows)


def _per_row(row: np.ndarray, h: np.ndarray, n: int, repeats: bool = False) -> pa.ListArray:
    """The hashes of each of ``n`` rows as lists of longs, each once unless ``repeats``."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = repeats | (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(h[new].view(np.int64)))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, text, words, size, seeds): the seed size of each item (its own length if shorter; 0: no word) and all its seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                part, here = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                count = seeds(part, here, [])[2]
                size = np.minimum(count, SEED)
                own = [seeds(part, here, [k])[:2] for k in range(1, SEED + 1)]
                own = [(r[size[r] == k + 1], h[size[r] == k + 1]) for k, (r, h) in enumerate(own)]
                row, h = (np.concatenate(x) for x in zip(*own, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(size.astype(np.int32)), _per_row(row, h, b - a, True)], names=["item_id", "text", "words", "size", "seeds"])

    return items.mapInArrow(freeing(run), "item_id long, text string, words long, size int, seeds array<long>")


def _rare_seeds(items: DataFrame, cover: float) -> DataFrame:
    """(item_id, seed): the seeds of which a text must share one to cover ``cover`` of an item.

    A seed's place covers at most ``SEED`` words, so a covered item has shared seeds at a least number of
    places; the commonest seeds (by the items that have them) with fewer places together prove nothing alone.
    """
    rows = items.select("item_id", "words", F.xxhash64("item_id", "text").alias("entry"), F.explode("seeds").alias("seed")).groupBy("entry", "item_id", "words", "seed").agg(F.count("*").alias("places"))
    rows = rows.join(rows.groupBy("seed").agg(F.count("*").alias("held")), "seed")
    needed = F.greatest(F.ceil(F.ceil(cover * F.col("words") - 1e-9) / SEED), F.lit(1))
    so_far = F.sum("places").over(Window.partitionBy("entry").orderBy(F.desc("held"), "seed"))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") >= needed).select("item_id", "seed").distinct()


def _bitmap(seeds_of: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits of all seeds (two bits each), put together from 4 KB parts made by tasks. Spark counts bits from 1."""
    parts = seeds_of.select(F.explode(F.array(*[F.pmod(F.shiftrightunsigned("seed", k), F.lit(bits)) + 1 for k in (0, 29)])).alias("bit"))
    parts = parts.groupBy(F.expr("bitmap_bucket_number(bit)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for part, piece in parts.collect():  # at most ``MOST_BITS`` / 32768 parts
        out[(part - 1) * 4096 : part * 4096] |= np.frombuffer(bytes(piece), np.uint8)
    return out


def _hits(docs: DataFrame, shared, bits: int, sizes: list[int]) -> DataFrame:
    """(h1, h2, text, seeds) of the texts that have a seed which the bitmap knows, and those seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for a, b in row_slices(offsets, SLICE_BYTES):
                row, h, _ = seeds(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sizes)
                for k in (0, 29):
                    at = ((h >> np.uint64(k)) % np.uint64(bits)).astype(np.int64)
                    hit = known[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
                    row, h = row[hit], h[hit]
                lists = _per_row(row, h, b - a)
                part = pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), lists], names=["h1", "h2", "text", "seeds"])
                yield part.filter(pa.array(np.bincount(row, minlength=b - a) > 0))

    return docs.select("h1", "h2", "text").mapInArrow(freeing(run), "h1 long, h2 long, text string, seeds array<long>")


def _tiled(rows: DataFrame) -> DataFrame:
    """(h1, h2, item_id, coverage) of rows (h1, h2, text, items): every pair is tiled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h1, h2, text, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = words((text or "").encode())
                out += [(h1, h2, x["item_id"], covered_share(own, words((x["item"] or "").encode()))) for x in items]
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["h1", "h2", "item_id", "coverage"])

    return rows.select("h1", "h2", "text", "items").mapInArrow(freeing(run), "h1 long, h2 long, item_id long, coverage double")


def coverages(texts: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(h1, h2, item_id, coverage, n_items) of each text (h1, h2, text) that covers an item to ``cover`` or more.

    Equal texts are one entry, so a group of copies is tiled once. A text with very many items is tiled
    in slices of about ``ITEMS_PER_SLICE`` items, so nothing that grows with the benchmark meets in one row.
    """
    spark = texts.sparkSession
    body = ["h1", "h2"]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    items = materialize(_item_seeds(items).where("size > 0"), "items")
    seeds_of = materialize(_rare_seeds(items, cover), "seeds")
    size = seeds_of.agg(F.approx_count_distinct("seed")).first()[0]
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, BITS_PER_SEED * size)).bit_length() - 1
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``SEED`` numbers
    shared = spark.sparkContext.broadcast(_bitmap(seeds_of, bits))
    hits = materialize(_hits(texts, shared, bits, sizes).dropDuplicates(body), "hits")
    pairs = materialize(hits.select(*body, F.explode("seeds").alias("seed")).join(seeds_of, "seed").select(*body, "item_id").distinct(), "pairs")
    slices = pairs.groupBy(*body).agg(F.ceil(F.count("*") / ITEMS_PER_SLICE).cast("int").alias("slices"))
    dealt = pairs.join(slices, body).select(*body, "item_id", F.pmod(F.xxhash64("item_id"), "slices").alias("slice"))
    sliced = dealt.join(items.select("item_id", F.col("text").alias("item")), "item_id").groupBy(*body, "slice").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    best = _tiled(sliced.join(hits, body)).where(F.col("coverage") >= cover).groupBy(*body, "item_id").agg(F.max("coverage").alias("coverage"))
    top = F.max(F.struct("coverage", (-F.col("item_id")).alias("least")))
    return best.groupBy(*body).agg(top.alias("top"), F.count("*").alias("n_items")).select(*body, (-F.col("top.least")).alias("item_id"), "top.coverage", "n_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: is some item of ``benchmark`` covered to ``cover`` or more? ``keep`` columns follow.

    item_id and coverage are those of the best of the items covered to ``cover`` (ties: the smallest id; null and 0 if there is
    none), n_items counts them. Null or empty texts and items
    share nothing, an item without id is left out; items shorter than a tile must occur whole; of an
    item_id with several texts the best covered one counts. Repeated rows and null ids give the results
    of their texts, empty tables are allowed, very long texts are taken whole, and other columns than
    those of ``keep`` are ignored, whatever their names.
    """
    text = F.col("text").cast("string")
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    found = materialize(coverages(docs.select(*hashes, text.alias("text")).where("text is not null"), benchmark, cover), "coverages")
    if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes, *[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)])
    out = rows.join(found, ["h1", "h2"], "left")
    share = F.coalesce("coverage", F.lit(0.0))
    return out.select("doc_id", (share >= cover).alias("contaminated"), "item_id", share.alias("coverage"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)])
