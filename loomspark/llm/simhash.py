"""SimHash near-duplicates by covering locality-sensitive hashing.

A radius r takes 2^(r+1) - 1 tables. Every fingerprint bit is given a non-zero vector of r + 1 bits;
table v keeps the bits whose vector has an odd number of ones in common with v. Whatever r bits
differ, their vectors span at most r dimensions, so some v is orthogonal to all of them and that
table keeps none of the differing bits: every pair within the radius meets in some table.

Only distinct fingerprints go to the tables, and only those that share a bucket are compared. A
bucket is not expanded into pairs: each of its fingerprints is listed under itself and under its
one-bit neighbours among the bits the table hides. Two fingerprints within distance two share such a
neighbour, and all that share one are within distance two, so each list links to its least member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_few, connected_components, discard, freeing, materialize, row_slices, text_buffers

BITS = 64
#: Longs in the parity sketch of a shingle set; sets of more shingles than that has cells get a wide sketch as well.
SKETCH = 8
LONG = 64 * SKETCH
#: Bytes of text that are digested together; a longer text stands alone.
SLICE_BYTES = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def covering_masks(radius: int) -> list[int]:
    """The kept bits of each table, as signed 64-bit masks. Bits take the vectors 1..2^(r+1)-1 in turn."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    masks = (sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, size))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shingle_hashes(raw: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``words`` space-joined words, repeats included (fewer: all of them)."""
    parts = raw.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(groups: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each group of hashes: bits set in over half of them; none: zero."""
    out = np.zeros(len(groups), np.uint64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i, h in enumerate(groups):
        ones = np.zeros(BITS, np.int64)
        for a in range(0, len(h), 1 << 16):
            part = h[a : a + (1 << 16)].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for every row; a null text has no words and so the fingerprint zero."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                groups = (shingle_hashes(raw[offsets[i] : offsets[i + 1]].tobytes(), words, seed) for i in range(a, b))
                fps = np.concatenate([majority_bits([g]) for g in groups])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freeing(digest), "doc_id long, fp long")


def covering_buckets(distinct: DataFrame, radius: int, column: str = "fp") -> DataFrame:
    """``distinct`` once for every table, with its number ``tab`` and the kept bits ``key``."""
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("tab"), F.col(column).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return distinct.withColumn("slot", F.explode(keys)).select(*distinct.columns, "slot.tab", "slot.key")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows of the buckets (tab, key) that hold more than one row."""
    full = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1").select("tab", "key")
    return rows.join(full, ["tab", "key"], "left_semi")


def link_within_two(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints connected by steps of 2 or fewer bits."""
    hidden = [[i for i in range(BITS) if not m >> i & 1] for m in covering_masks(2)]
    signed = lambda i: (1 << i) - (1 << 64) if i == 63 else 1 << i
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(i)).cast("long") for i in bits]) for bits in hidden])
    near = shared_buckets(covering_buckets(distinct.select("fp"), 2))
    listed = near.withColumn("flip", F.explode(flips[F.col("tab")])).select("tab", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("list"))
    least = F.min("fp").over(Window.partitionBy("tab", "list"))
    return listed.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b").distinct()


def simhash_components(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints link at 2 or fewer differing bits; component_id is the smallest doc_id reachable.
    Documents without words share the fingerprint zero and link like any other. Repeated rows stay
    repeated, an empty table gives no rows, extra columns are ignored.
    """
    prints = materialize(fingerprints(docs, words, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = connected_components(link_within_two(distinct), "simhash")
    named = distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """The sorted set of shingle hashes; a text without words has one stand-in, so that all such texts are alike."""
    h = np.unique(shingle_hashes(raw, words))
    return h if len(h) else np.zeros(1, np.uint64)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of ``texts`` (doc_id, text): the set of shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                own = [shingle_set(raw[offsets[i] : offsets[i + 1]].tobytes(), words) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(own)], names=["id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(freeing(sets), "id long, shingles array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def frequent_shingles(texts: DataFrame, words: int, sample: int = 5000, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``sample`` texts hold, sorted, and how many texts hold them.

    They only order the shingles for ``prefixes``: any order gives the same links, this one fewer candidates.
    """
    step = max(1, texts.count() // sample)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i in range(batch.num_rows):
                h = shingle_set(raw[offsets[i] : offsets[i + 1]].tobytes(), words)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["token"])

    dealt = texts.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    counts = dealt.mapInArrow(freeing(hashes), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.orderBy(F.desc("n"), "token").limit(most).collect()
    tokens = np.array([x["token"] for x in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([x["n"] for x in rows], np.int64)[order]


def prefixes(texts: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, tokens, sketch, wide, fp) of ``texts`` (doc_id, text): the size of the shingle set, its prefix, its parity sketches and its fingerprint.

    In one order of all shingles (rare first), two sets of Jaccard similarity s share one of their
    first n - ceil(s n) + 1 shingles. The sketch holds, for each of ``SKETCH`` x 64 cells, whether
    an odd number of shingles falls in it: two sketches never differ in more bits than their sets
    differ in shingles. The wide sketch of a long set has a cell for each shingle, rounded up to a power of two.
    """
    known, held = common

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                sizes, tokens, wide, prints, sketches = [], [], [], [], np.zeros((b - a, SKETCH), np.uint64)
                for i in range(a, b):
                    h = shingle_set(raw[offsets[i] : offsets[i + 1]].tobytes(), words)
                    length = len(h) - least_shared(similarity * len(h)) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        first = h[np.argsort(np.where(known[at] == h, held[at], 0), kind="stable")[:length]]
                    else:
                        first = h[:length]
                    sketches[i - a] = parities(h, 64 * SKETCH)
                    wide.append(parities(h, 1 << (len(h) - 1).bit_length()) if len(h) > LONG else np.zeros(0, np.uint64))
                    sizes.append(len(h))
                    tokens.append(first)
                    prints.append(majority_bits([h]))
                cells = pa.ListArray.from_arrays(np.arange(0, sketches.size + 1, SKETCH, dtype=np.int32), pa.array(sketches.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int32()), _lists(tokens), cells, _lists(wide), pa.array(np.concatenate(prints).view(np.int64))], names=["id", "n", "tokens", "sketch", "wide", "fp"])

    return texts.select("doc_id", "text").mapInArrow(freeing(digest), "id long, n int, tokens array<long>, sketch array<long>, wide array<long>, fp long")


def parities(h: np.ndarray, cells: int) -> np.ndarray:
    """A bit for each of ``cells`` cells: does an odd number of hashes fall in it?"""
    odd = np.bincount((h % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64)


def least_shared(x: float) -> int:
    """The least whole number that is not below ``x``, rounding errors of ``x`` aside."""
    return int(np.ceil(x - 1e-9))


def can_be_similar(similarity: float) -> Column:
    """Do sizes and sketches of two sides (n, sketch and other_n, other_sketch) leave room for ``similarity``? No similar pair is lost."""
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other_sketch")[i])) for i in range(1, SKETCH)), F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("other_sketch")[0])))
    total = F.col("n") + F.col("other_n")
    room = total - 2 * F.ceil(total * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
    return (F.least("n", "other_n") >= F.greatest("n", "other_n") * F.lit(similarity) - F.lit(1e-6)) & (apart <= room)


def wide_enough(pairs: DataFrame, listed: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) that the wide sketches leave room for, too, if both sets are long; no similar pair is lost.

    A sketch of half as many cells is the exclusive or of the halves, so sketches of neighbouring sizes compare.
    """
    side = lambda c: listed.where(F.col("n") > LONG).select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    half = lambda w: (F.size(w) / 2).cast("int")
    folded = lambda w: F.zip_with(F.slice(w, F.lit(1), half(w)), F.slice(w, half(w) + 1, half(w)), lambda p, q: p.bitwiseXOR(q))
    fit = lambda w, other: F.when(F.size(w) > F.size(other), folded(w)).otherwise(F.col(w))
    bits = F.zip_with(fit("wide_a", "wide_b"), fit("wide_b", "wide_a"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    total = F.col("n_a") + F.col("n_b")
    room = total - 2 * F.ceil(total * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))
    return both.where(F.col("n_a").isNull() | F.col("n_b").isNull() | (apart <= room)).select("a", "b")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose ``sets`` have at least that Jaccard similarity.

    Two joins and an array function, row by row: no batch of sets is ever held, and a document with
    very many partners is a skewed join, which adaptive execution splits.
    """
    side = lambda c, s: sets.select(F.col("id").alias(c), F.col("shingles").alias(s))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.ceil((F.size("x") + F.size("y")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6))).select("a", "b")


def fingerprint_pairs(listed: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of ``listed`` (id, n, sketch, fp) that SimHash links and that may be similar.

    Every document and the first of its fingerprint, and the first ones of fingerprints that differ in 2 or fewer bits.
    """
    prints = listed.select("id", "fp")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    own = prints.join(distinct, "fp").where("id <> first").select("id", F.col("first").alias("other"))
    first = lambda fp, name: distinct.select(F.col("fp").alias(fp), F.col("first").alias(name))
    linked = link_within_two(distinct).join(first("a", "id"), "a").join(first("b", "other"), "b").select("id", "other")
    side = listed.select("id", "n", "sketch")
    pairs = own.unionAll(linked).join(side, "id").join(side.toDF("other", "other_n", "other_sketch"), "other").where(can_be_similar(similarity))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def candidate_pairs(shared: DataFrame, sketches: DataFrame, linked: DataFrame | None, turn: int, similarity: float) -> DataFrame:
    """(a, b): pairs of documents of one bucket (token) of ``shared`` (token, id) that may be similar and are not ``linked`` yet.

    Turn 0: every member and the least one. Turn 1: every member outside the bucket's largest group
    and one member of that group. Turn 2: members of different groups. A pair is judged by sizes and
    sketches (id, n, sketch) where it meets, so one that cannot be similar is never written or shuffled.
    """
    other = sketches.select(F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("sketch").alias("other_sketch"))
    if linked is None:
        now = shared.withColumn("group", F.col("id"))
    else:
        now = shared.join(linked.select(F.col("node").alias("id"), "component"), "id", "left").select("token", "id", F.coalesce("component", "id").alias("group"))
    if turn == 0:
        least = now.groupBy("token").agg(F.min("id").alias("other"))
        pairs = now.join(least, "token").where("id <> other").select("id", "other").distinct()
        if linked is not None:  # what fingerprints have linked is not compared again
            group = linked.select(F.col("node").alias("id"), "component")
            apart = pairs.join(group, "id", "left").join(group.toDF("other", "other_component"), "other", "left")
            pairs = apart.where(~F.coalesce(F.col("component") == F.col("other_component"), F.lit(False))).select("id", "other")
    else:
        groups = now.groupBy("token", "group").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "token")).alias("lead"))
        main = groups.groupBy("token").agg(F.max(F.struct("n", "group", "lead")).alias("m"), F.count("*").alias("groups")).where("groups > 1")
        main = main.select("token", F.col("m.group").alias("main"), F.col("m.lead").alias("lead"))
        outside = now.join(main, "token").where("group <> main")
        if turn == 1:
            pairs = outside.select("id", F.col("lead").alias("other")).distinct()
        else:
            own = outside.join(sketches, "id")
            open_ = now.join(main.select("token"), "token", "left_semi").withColumnsRenamed({"id": "other", "group": "other_group"}).join(other, "other")
            pairs = own.join(open_, "token").where((F.col("group") != F.col("other_group")) & ((F.col("other_group") == F.col("main")) | (F.col("id") < F.col("other"))) & can_be_similar(similarity))
    if turn < 2:
        pairs = pairs.join(sketches, "id").join(other, "other").where(can_be_similar(similarity))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id): groups of documents linked by a word-shingle similarity of at least ``similarity``.

    SimHash comes first: documents of one fingerprint, and of fingerprints within 2 bits (see ``link_within_two``), are
    candidates, verified exactly. A fingerprint of 64 bits leaves out pairs whose fingerprints are farther apart,
    so a prefix filter completes the links. Exact: a pair of that similarity shares a shingle of both prefixes (see ``prefixes``), so all
    candidates meet in the buckets of the prefix shingles, and a candidate is dropped only where sizes
    or sketches exclude the similarity, or where both documents are in one group already. Two turns of
    comparisons with one member of each bucket find most groups, so that the last turn, which looks at
    all members of different groups in each bucket, does not compare the copies of one text with each
    other. Exact copies are one entry. group_id is the smallest doc_id of the group. Documents without
    words, null and empty texts included, are copies of each other; a null doc_id is left out. Repeated
    rows give repeated rows, an empty table gives none, other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")
    body = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    keys = materialize(source.select("doc_id", *body), "bodies")
    firsts = materialize(keys.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "firsts")
    # Copies take part in the buckets of no use: only first copies are listed.
    only = firsts.select(F.col("first").alias("id")).distinct()
    listed = materialize(prefixes(source, words, similarity, frequent_shingles(source, words)).join(only, "id", "left_semi"), "prefixes")
    rows = listed.select("id", F.explode("tokens").alias("token"))
    full = rows.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("token")
    shared = materialize(rows.join(full, "token", "left_semi").select("token", "id").distinct(), "shared")
    sketches = listed.select("id", "n", "sketch")
    edges, linked, used = None, None, [firsts, listed, shared]
    for turn in (None, 0, 1, 2):
        found = fingerprint_pairs(listed, similarity) if turn is None else candidate_pairs(shared, sketches, linked, turn, similarity)
        pairs = materialize(wide_enough(found, listed, similarity), "candidates")
        used.append(pairs)
        if pairs.isEmpty():
            continue
        # The texts are read once more, for the shingles of those that are compared.
        ids = broadcast_if_few(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct())
        sets = materialize(shingle_sets(source.join(ids, "doc_id", "left_semi"), words), "shingles")
        good = materialize(similar_pairs(pairs, sets, similarity), "similar")
        discard(sets)
        used.append(good)
        edges = good if edges is None else edges.unionAll(good)
        linked = connected_components(edges, "near")
        used.append(linked)
    named = firsts
    if linked is None:
        named = named.withColumn("group_id", F.col("first"))
    else:
        named = named.join(linked, F.col("first") == F.col("node"), "left").withColumn("group_id", F.coalesce("component", "first"))
    named = materialize(named.select("h1", "h2", "group_id"), "named")
    for table in used:
        discard(table)
    return keys.join(named, ["h1", "h2"]).select("doc_id", "group_id")
