"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit agree on all but a short middle. Each line is cut into ``PARTS`` parts by
position; for each part, the rest of the line (a prefix and a suffix) makes a hashed key, so lines
within one edit share the key of the part that holds the edit. Only keys that two different lines
share are followed up. There every variant of the middle, itself and each one-character deletion
with its place, is emitted as a hashed key. Equal variants meet in a bucket that keeps the earliest
line for each; the pair of a line and that earliest one is verified by edit distance on the lines
themselves. No group is expanded into pairs, and no text is cut short.

Hashes of any part of a line come from prefix sums of a polynomial over the code points of a block
of text, so a key or a variant costs the same however long the line is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, freeing_group, row_slices, text_buffers, text_bytes
from .suffix_dedup import _by_doc, _mix, _pack, _runs, _runs_of, _unpack

#: Shorter lines are never duplicates: such strings repeat by chance in clean documents.
MIN_CHARS, PARTS, QUANTUM = 30, 4, 4
#: Text bytes for each bucket; bytes of a block; different lines that make a key hot in one block.
BUCKET_BYTES, BLOCK_BYTES, HOT = 16 << 20, 1 << 19, 64
EXACT, ASKS, NEAR = b"x", b"a", b"n"
_ASK = np.dtype([("key", "<u8"), ("line", "<i8")])
_VARIANT = np.dtype([("v", "<u8"), ("w", "<u4"), ("kind", "u1"), ("doc", "<i8"), ("line", "<i8")])
_PAIR = np.dtype([("line", "<i8"), ("doc2", "<i8"), ("line2", "<i8")])
_B = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_C = np.uint64(0xC2B2AE3D27D4EB4F)
#: Hash bits of a key that travel.
_KEY = ~np.uint64(0xFFFF)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, at least ``n`` of them."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        up = np.full(size, _B[which], np.uint64)
        down = np.full(size, pow(_B[which], -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


class _Block:
    """The long lines of some texts: text row, line number, first and last code point, hashes of any part."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, min_chars: int):
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = chars[offsets]
        cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        n = len(cp)
        breaks = np.flatnonzero(cp == 10)
        rows = np.concatenate([np.searchsorted(bounds, breaks, side="right") - 1, np.arange(len(bounds) - 1)])
        ends = np.concatenate([breaks, bounds[1:]])
        order = np.lexsort((ends, rows))
        rows, ends = rows[order], ends[order]
        new = np.concatenate([[True], rows[1:] != rows[:-1]])
        starts = np.where(new, bounds[rows], np.concatenate([[0], ends[:-1] + 1]))
        number = np.arange(len(rows)) - _runs(~new)
        if n:
            solid = cp != 32
            spots = np.arange(n)
            after = np.minimum.accumulate(np.where(solid, spots, n)[::-1])[::-1]
            before = np.maximum.accumulate(np.where(solid, spots, -1))
            starts = np.minimum(np.concatenate([after, [n]])[starts], ends)
            ends = np.where(ends > starts, np.maximum(before[np.maximum(ends - 1, 0)] + 1, starts), starts)
        long = ends - starts >= min_chars
        self.row, self.number, self.start, self.end = rows[long], number[long], starts[long], ends[long]
        code = _mix(cp.astype(np.uint64) + np.uint64(1))
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(code * _power(i, n + 1)[0][:n], dtype=np.uint64)]) for i in (0, 1)]
        self.size = n + 1

    def polynomial(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Of the code points from a up to b, whatever stands before them."""
        return (self.sums[which][b] - self.sums[which][a]) * _power(which, self.size)[1][a]

    def hashed(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        return _mix(self.polynomial(a, b, which) + (b - a).astype(np.uint64) * _C)

    def middles(self, lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part and base length: (key, does it stand, first, last code point of the middle)."""
        s, e = self.start[lines], self.end[lines]
        own, shorter = (e - s) // QUANTUM * QUANTUM, (e - s - 1) // QUANTUM * QUANTUM
        for base, stands in ((own, np.ones(len(s), bool)), (shorter, shorter != own)):
            width = -(-base // PARTS)
            for j in range(PARTS):
                a, b = s + j * width, e - np.maximum(base - (j + 1) * width, 0)
                outside = self.hashed(s, a) * np.uint64(3) + self.hashed(b, e) * np.uint64(5)
                yield _mix(outside + (base * PARTS + j).astype(np.uint64) * _C) & _KEY, stands, a, b


def _first_runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first is most significant), and whether a row equals the one before in all but the last two."""
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys[:-2]])
    return order, same


MAPPED = "bucket int, doc_id long, mark binary, hot binary, lines binary, keys binary"


def _map_lines(buckets: int, min_chars: int, max_edits: int, block_bytes: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in row_slices(offsets, block_bytes):
                block = _Block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_chars)
                if not len(block.row):
                    continue
                doc, number = ids[a:b][block.row], block.number
                h1, h2 = (block.hashed(block.start, block.end, i) for i in (0, 1))
                order, same = _first_runs(h1, h2, doc, number)
                first = order[_runs(same)]
                gone = same & ((doc[order] != doc[first]) | (number[order] != number[first]))
                rows = [(-1 - k % buckets, k, EXACT + v.astype("<i8").tobytes(), None, None, None) for k, v in _by_doc(doc[order[gone]], number[order[gone]])]
                # What an earlier row of the block equals is settled; one line of each kind goes on.
                kept = np.sort(order[~same])
                parts = defaultdict(lambda: [b"", None, None])
                for k, spot in _runs_of((h1[kept] % np.uint64(buckets)).astype(np.int64)):
                    own = kept[spot]
                    parts[k][1] = _pack(h1[own], h2[own], doc[own], number[own])
                if max_edits:
                    found = [(key[on], kept[on]) for key, on, _, _ in block.middles(kept)]
                    key, line = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                    names, group, size = np.unique(key, return_inverse=True, return_counts=True)
                    hot = (size > most)[group]
                    asks = np.zeros(int(hot.sum()), _ASK)
                    asks["key"], asks["line"] = key[hot], number[line[hot]]
                    rows += [(-1 - k % buckets, k, ASKS + v.tobytes(), None, None, None) for k, v in _by_doc(doc[line[hot]], asks)]
                    for k, v in _by_doc((names[size > most] >> np.uint64(16)).astype(np.int64) % buckets, names[size > most]):
                        parts[k][0] = v.astype("<u8").tobytes()
                    key, line = key[~hot], line[~hot]
                    for k, own in _runs_of((key >> np.uint64(16)).astype(np.int64) % buckets):
                        parts[k][2] = _pack(key[own], h1[line[own]], doc[line[own]], number[line[own]])
                rows += [(k, None, None, *v) for k, v in parts.items() if any(v)]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MAPPED.split(", ")])

    return run


def _marks(out: list[tuple]) -> pa.Table:
    cols = list(zip(*out, strict=True)) or [()] * 2
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary()), strict=True)], names=["doc_id", "mark"])


def _settle_lines(t: pa.Table) -> pa.Table:
    """One bucket: lines that an earlier one equals, and lines that share a key with a different line."""
    out: list[tuple] = []
    hot, lines, keys = [], [], []
    for k, doc, mark, h, ls, ks in zip(*[t.column(i).to_pylist() for i in range(6)], strict=True):
        if k < 0:
            out.append((doc, mark))
        else:
            hot.append(h or b"")
            lines += [ls] if ls else []
            keys += [ks] if ks else []
    if lines:
        h1, h2, doc, number = (np.concatenate(x) for x in zip(*map(_unpack, lines), strict=True))
        order, same = _first_runs(h1, h2, doc, number)
        doc, number, first = doc[order], number[order], _runs(same)
        gone = (doc != doc[first]) | (number != number[first])
        out += [(k, EXACT + v.astype("<i8").tobytes()) for k, v in _by_doc(doc[gone], number[gone])]
    if keys:
        key, line, doc, number = (np.concatenate(x) for x in zip(*map(_unpack, keys), strict=True))
        order, same = _first_runs(key, line, doc, number)
        own = order[~same]  # the earliest place of each line of a key
        key, doc, number = key[own], doc[own], number[own]
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        shared = (size > 1)[group] | np.isin(key, np.frombuffer(b"".join(hot), "<u8"))
        asks = np.zeros(int(shared.sum()), _ASK)
        asks["key"], asks["line"] = key[shared], number[shared]
        out += [(k, ASKS + v.tobytes()) for k, v in _by_doc(doc[shared], asks)]
    return _marks(out)


def _emit_variants(buckets: int, min_chars: int):
    """The variants of the middles asked for, to the bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for a, b in row_slices(offsets, BLOCK_BYTES):
                block = _Block(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_chars)
                asked = [(i, np.unique(np.concatenate([np.frombuffer(x, _ASK, offset=1) for x in marks[a + i] if x[:1] == ASKS]))) for i in range(b - a)]
                row = np.concatenate([np.full(len(x), i) for i, x in asked])
                asks = np.concatenate([x for _, x in asked])
                place = block.row * (1 << 40) + block.number
                line = np.minimum(np.searchsorted(place, row * (1 << 40) + asks["line"]), len(place) - 1)
                there = place[line] == row * (1 << 40) + asks["line"] if len(place) else np.zeros(len(row), bool)
                row, asks, line = row[there], asks[there], line[there]
                first, last = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                hit = np.zeros(len(row), bool)
                for key, on, x, y in block.middles(line) if len(row) else ():
                    now = on & (key == asks["key"])
                    first[now], last[now] = x[now], y[now]
                    hit |= now
                row, asks, first, last = row[hit], asks[hit], first[hit], last[hit]
                size = last - first
                of = np.repeat(np.arange(len(row)), size)
                i = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                parts = []
                for kind, ask in ((1, np.arange(len(row))), (0, of), (2, of)):
                    x, y = first[ask], last[ask]
                    v = []
                    for which in (0, 1):
                        if kind == 1:
                            h = block.polynomial(x, y, which) + (y - x).astype(np.uint64) * _C
                        else:  # what stands before and behind the character that is left out
                            behind = block.polynomial(x + i + 1, y, which) * _power(which, block.size)[0][i]
                            h = block.polynomial(x, x + i, which) + behind + (y - x - 1).astype(np.uint64) * _C
                        spot = (i + 1).astype(np.uint64) if kind == 2 else np.uint64(0)
                        v.append(_mix(_mix(h) * np.uint64(7) + asks["key"][ask] + spot * _C))
                    own = np.zeros(len(ask), _VARIANT)
                    own["v"], own["w"], own["kind"] = v[0], (v[1] >> np.uint64(32)).astype(np.uint32), kind
                    own["doc"], own["line"] = ids[a:b][row[ask]], asks["line"][ask]
                    parts.append(own)
                every = np.concatenate(parts)
                to = (every["v"] % np.uint64(buckets)).astype(np.int64)
                out = [(k, v.tobytes()) for k, v in _by_doc(to, every)]
                cols = list(zip(*out, strict=True)) or [()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary()), strict=True)], names=["bucket", "variants"])

    return run


def _meet(t: pa.Table) -> pa.Table:
    """Pairs of a line and the earliest line that has one of its variants.

    Deletions at one place (kind 2) mean lines one substitution apart. A whole middle (kind 1) meets
    deletions (kind 0) of lines one character longer, but two deletions without a place do not count.
    """
    x = np.frombuffer(b"".join(t.column("variants").to_pylist()), _VARIANT)
    order, same = _first_runs(x["v"], x["w"], x["doc"], x["line"])
    x = x[order]
    run = _runs(same)
    # The first whole middle of a run: rows are in the order of lines, so its first whole row.
    spots = np.arange(len(x))
    whole = np.full(len(x), len(x))
    np.minimum.at(whole, run, np.where(x["kind"] == 1, spots, len(x)))
    best = np.where(x["kind"] == 0, whole[run], run)
    ok = best < len(x)
    best = np.minimum(best, len(x) - 1)
    ok &= (x["doc"][best] < x["doc"]) | ((x["doc"][best] == x["doc"]) & (x["line"][best] < x["line"]))
    pairs = np.zeros(int(ok.sum()), _PAIR)
    pairs["line"], pairs["doc2"], pairs["line2"] = x["line"][ok], x["doc"][best[ok]], x["line"][best[ok]]
    found = [(k, int(p["line"]), int(p["doc2"]), int(p["line2"])) for k, v in _by_doc(x["doc"][ok], pairs) for p in np.unique(v)]
    cols = list(zip(*found, strict=True)) or [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "line_no", "doc2", "line2"])


def _cut_lines(n_keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2 + n_keep).to_pylist(), strict=True):
                exact, near = (np.unique(np.concatenate([np.zeros(0, "<i8"), *[np.frombuffer(m, "<i8", offset=1) for m in marks or () if m[:1] == tag]])) for tag in (EXACT, NEAR))
                near = np.setdiff1d(near, exact)
                n = 0
                if text is not None:
                    lines = text.split("\n")
                    n = len(lines)
                    if len(exact) or len(near):
                        gone = {*exact.tolist(), *near.tolist()}
                        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                texts.append(text)
                counts.append((n, len(exact), len(near)))
            cols = list(zip(*counts, strict=True)) or [()] * 3
            keep = [batch.column(2 + i) for i in range(n_keep)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in cols], *keep], names=["doc_id", "text", "n_lines", "n_exact", "n_near", *batch.schema.names[2 : 2 + n_keep]])

    return run


def line_dedup(
    docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES, hot: int = HOT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without the removed lines, and counts.

    A line of at least ``min_chars`` characters, blanks around it aside, goes if an earlier line, in
    this or another document, equals it (n_exact) or is within ``max_edits`` (0 or 1) of it (n_near).
    Order is (doc_id, line number); the earliest stays, shorter lines always stay. A null text stays
    null with no lines, an empty one has one empty line. Rows with equal doc_id count as one place, so
    repeated rows do not remove each other's lines; a null doc_id keeps all its lines. Of further
    columns only those named in ``keep`` are passed on, last.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    rest = source.columns[2:]
    # All joins deal out the same rows by doc_id, so the texts are shuffled once and the exchange is read again.
    keyed = source.where("doc_id is not null")
    buckets = max(1, -(-text_bytes(keyed) // bucket_bytes))
    mapped = keyed.select("doc_id", "text").mapInArrow(freeing(_map_lines(buckets, min_chars, max_edits, block_bytes, hot)), MAPPED)
    settled = mapped.groupBy("bucket").applyInArrow(freeing_group(_settle_lines), "doc_id long, mark binary")
    by_doc = settled.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    every = by_doc
    if max_edits:
        near = _near_marks(keyed, rest, by_doc, buckets, min_chars)
        every = by_doc.unionAll(near).groupBy("doc_id").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    marked = keyed.join(every.withColumnRenamed("doc_id", "k").hint("shuffle_hash"), F.col("doc_id") == F.col("k"), "left").select(*source.columns, "marks")
    schema = T.StructType([*T._parse_datatype_string("doc_id long, text string, n_lines long, n_exact long, n_near long").fields, *[source.schema[c] for c in rest]])
    without = source.where("doc_id is null").withColumn("marks", F.lit(None).cast("array<binary>"))
    out = marked.mapInArrow(freeing(_cut_lines(len(rest))), schema).unionAll(without.mapInArrow(freeing(_cut_lines(len(rest))), schema))
    return out.select("doc_id", "text", "n_lines", "n_exact", "n_near", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def _near_marks(keyed: DataFrame, rest: list[str], by_doc: DataFrame, buckets: int, min_chars: int) -> DataFrame:
    """(doc_id, marks) of the lines that an earlier, different line is one edit from."""
    asking = by_doc.where(F.exists("marks", lambda m: F.substring(m, 1, 1) == F.lit(ASKS))).select(F.col("doc_id").alias("k"), "marks")
    asked = keyed.join(asking.hint("shuffle_hash"), F.col("doc_id") == F.col("k")).select("doc_id", "text", "marks", *rest)
    variants = asked.mapInArrow(freeing(_emit_variants(buckets, min_chars)), "bucket int, variants binary")
    pairs = variants.groupBy("bucket").applyInArrow(freeing_group(_meet), "doc_id long, line_no long, doc2 long, line2 long").distinct()
    # Verification: both lines of each pair are fetched from their documents and compared.
    pair = F.struct("doc_id", "line_no", "doc2", "line2")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("doc_id").alias("k"), F.col("line_no").alias("line"), pair.alias("pair"), F.lit(0).alias("side")), F.struct(F.col("doc2").alias("k"), F.col("line2").alias("line"), pair.alias("pair"), F.lit(1).alias("side")))).alias("s"))
    wanted = sides.groupBy("s.k").agg(F.collect_list("s").alias("wants"))
    found = keyed.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("k")).select("doc_id", "text", "wants", *rest)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wants in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                out += [(*w["pair"].values(), w["side"], lines[w["line"]].strip(" ")) for w in wants if w["line"] < len(lines)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "line_no", "doc2", "line2", "side", "line"])

    texts = found.mapInArrow(freeing(fetch), "doc_id long, line_no long, doc2 long, line2 long, side int, line string")
    both = texts.groupBy("doc_id", "line_no", "doc2", "line2").agg(F.max(F.when(F.col("side") == 0, F.col("line"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("line"))).alias("y"))
    sure = both.where(F.levenshtein("x", "y", 1).between(0, 1)).select("doc_id", "line_no").distinct()
    # A line number as eight little-endian bytes, as in the other marks.
    number = F.reverse(F.lpad(F.hex("line_no"), 16, "0"))
    little = F.unhex(F.regexp_replace(number, "(.)(.)", "$2$1"))
    return sure.groupBy("doc_id").agg(F.collect_list(F.concat(F.lit(NEAR), little)).alias("marks"))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: the kept text as its MD5 (null text: that of an empty one)."""
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def oracle() -> str:
    """The digest in DuckDB SQL: lines that agree on a half are compared directly."""
    return f"""
WITH lines AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
long AS (SELECT doc_id, line_no, doc_id::HUGEINT * 2147483648 + line_no AS o, trim(raw, ' ') AS line FROM lines WHERE length(trim(raw, ' ')) >= {MIN_CHARS}),
firsts AS (SELECT line, min(o) AS first, length(line) AS n FROM long GROUP BY line),
halves AS (SELECT line, first, n, b, left(line, b // 2) AS k, 0 AS side FROM (SELECT *, unnest([n, n - 1]) AS b FROM firsts)
  UNION ALL SELECT line, first, n, b, right(line, b - b // 2), 1 FROM (SELECT *, unnest([n, n - 1]) AS b FROM firsts)),
near AS (SELECT DISTINCT x.line FROM halves x JOIN halves y ON x.b = y.b AND x.side = y.side AND x.k = y.k AND y.first < x.first WHERE abs(x.n - y.n) <= 1 AND levenshtein(x.line, y.line) <= 1),
flags AS (SELECT l.doc_id, l.line_no, l.o > f.first AS same, n.line IS NOT NULL AS near FROM long l JOIN firsts f USING (line) LEFT JOIN near n USING (line)),
every AS (SELECT l.doc_id, l.line_no, l.raw, coalesce(f.same, false) AS same, coalesce(f.near AND NOT f.same, false) AS near FROM lines l LEFT JOIN flags f USING (doc_id, line_no))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (same))::BIGINT AS n_exact, (count(*) FILTER (near))::BIGINT AS n_near,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT same AND NOT near), '')) AS kept_md5
FROM every GROUP BY doc_id"""
