"""Best-fit packing by large-item matching.

A packing depends only on how many pieces there are of each length, so the plan is made from the
length histogram (at most ``capacity`` counts, whatever the corpus). Pieces above a third of the
capacity can stand in pairs only: the longest first, each is matched with the longest partner that
fits, equal matches in bulk. Smaller pieces, longest first, go to the tightest gap that takes them;
a run of equal pieces and equal gaps is one step. Each piece then looks up its place by its rank
among the pieces of its length. Ranks come from counts per (length, salt), so no length's rows meet
in one task and a lost task can be computed again.
"""

from __future__ import annotations

import heapq
import re
import string
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import freeing, materialize

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
PLACED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

#: A worker keeps its tokenizer and, within a task, the ids of the chunks it has met, up to this many.
CACHE_ENTRIES = 60_000
_tokenizers: dict[str, _Encoder] = {}
#: White space to Python but not to the tokenizer; letters whose lower case depends on their place.
_CONTROL, _DIRECT = re.compile("[\x1c-\x1f]"), re.compile("[\x1c-\x1fΣİ]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """A tokenizer file and the ids of recent chunks, kept in two generations of bounded size."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Literals of special tokens, which the tokenizer takes as one id wherever they stand.
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        #: Byte-level alphabet: a printable byte stands for itself, any other for the next code point from 256.
        self.letters = {b: b if b in printable else next(other) for b in range(256)}
        self.marks: dict[str, bytes] = {"": b""}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of one lower-case Latin word, which the tokenizer never splits further."""
        if not w.isascii():
            w = w.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(w)]).tobytes()

    def mark(self, run: str) -> bytes:
        """Ids of a run of ASCII punctuation, which the tokenizer takes as one unit."""
        if (ids := self.marks.get(run)) is None:
            ids = self.direct(run)
            if len(self.marks) < 5000:
                self.marks[run] = ids
        return ids

    def chunk(self, c: str) -> bytes:
        core = c.rstrip(string.punctuation)
        tail = c[len(core) :]
        if core.isalpha() and max(core) < "\u0250":
            return self.word(core) + self.mark(tail) if tail else self.word(core)
        bare = core.lstrip(string.punctuation)
        head = core[: len(core) - len(bare)]
        if bare.isalpha() and max(bare) < "\u0250" and head[:1] != "'":  # an apostrophe may open a contraction
            return self.mark(head) + self.word(bare) + self.mark(tail)
        return self.direct(c)

    def forget(self) -> None:
        """Let go of the chunks' ids: workers live on for other tasks, which need the memory."""
        self.young, self.old = {}, {}

    def known(self, chunks: set[str]) -> dict[str, bytes]:
        if len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for c in chunks.difference(young):
            young[c] = old.get(c) or self.chunk(c)
        return young


def _loaded(path: str) -> _Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = _Encoder(path)
    return _tokenizers[path]


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's token ids as 32-bit words in the machine's (little-endian) order.

    The tokenizer splits at white space before anything else, so a text's ids are those of its
    white-space chunks in a row, and a chunk met before need not be encoded again. Texts whose
    lower case or white space depends on more than the chunk, or that hold a special literal, take the direct way.
    """
    encoder = _loaded(path)
    out: list[bytes] = [b""] * len(texts)
    chunks: dict[int, list[str]] = {}
    for i, t in enumerate(texts):
        if not t:
            continue
        if any(s in t for s in encoder.special):
            out[i] = encoder.direct(t)
        elif t.isascii() and not _CONTROL.search(t) or not _DIRECT.search(t) and unicodedata.is_normalized("NFC", t):
            chunks[i] = t.lower().split()
        else:
            out[i] = encoder.direct(t)
    ids = encoder.known(set().union(*chunks.values()))
    for i, words in chunks.items():
        out[i] = b"".join(map(ids.__getitem__, words))
    return out


def tokenize_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids, ``end_id`` last, cut at the capacity."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode_texts(part.column(1).to_pylist(), path), strict=True):
                    ids += end
                    rows += [(doc, k, k * capacity, (len(c) // 4), zlib.crc32(c)) for k in range(-(-len(ids) // (4 * capacity))) for c in [ids[4 * capacity * k : 4 * capacity * (k + 1)]]]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)
        _loaded(path).forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(cut), PIECES)


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, bins, each, first bin, offset).

    A step puts ``bins * each`` pieces of one length, by rank, into that many consecutive bins;
    each bin gets ``each`` of them in a row from ``offset``. Equal to placing the pieces one by one.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted; bins by their gap, as ranges (first bin, bins)
    bins: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in bins:
                insort(gaps, gap)
                bins[gap] = []
            heapq.heappush(bins[gap], (first, n))

    def take(n: int, k: int, each: int, first: int, offset: int) -> None:
        steps.append((n, used[n], k, each, first, offset))
        used[n] += k * each
        left[n] -= k * each

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        fit = bisect_left(large, capacity - n + 1) - 1
        while fit >= 0 and (not left[large[fit]] or large[fit] == n and left[n] == 1):
            if not left[large[fit]]:
                large.pop(fit)
            fit -= 1
        mate = large[fit] if fit >= 0 else 0
        k = left[n] // 2 if mate == n else min(left[n], left[mate]) if mate else left[n]
        take(n, k, 2 if mate == n else 1, made, 0)
        if mate and mate != n:
            take(mate, k, 1, made, n)
        put(capacity - n - mate, made, k)
        made += k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                k = -(-left[n] // (capacity // n))
                gap, first, size = capacity, made, k
                made += k
            else:
                gap = gaps[at]
                first, size = heapq.heappop(bins[gap])
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
            each = gap // n
            full = min(size, left[n] // each)
            if full:
                take(n, full, each, first, capacity - gap)
                put(gap - each * n, first, full)
            rest = left[n] if full < size else 0
            if rest:
                take(n, 1, rest, first + full, capacity - gap)
                put(gap - rest * n, first + full, 1)
                full += 1
            put(gap, first + full, size - full)
    return steps


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_group: int = 2_000) -> DataFrame:
    """``pieces`` (PIECES) with sequence_id and offset; pieces longer than the capacity are an error.

    Equal lengths are ranked by (salt, doc_id, piece, start, ids_crc32); repeated rows get places of
    their own. The plan is broadcast: it has a few steps for each length up to the capacity.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.select(*PIECES.names), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` lengths
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    steps = plan_packing(counts, capacity)
    shared = spark.sparkContext.broadcast(np.array(sorted(steps), np.int64).reshape(-1, 6))
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // rows_per_group)) for n, c in counts.items()], "length long, salts int"))
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts").cast("int"))
    groups = salted.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = groups.select("length", "salt", before.alias("base"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("number", number - 1).join(bases, ["length", "salt"]).select(*PIECES.names, (F.col("base") + F.col("number")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = plan[:, 0] * (1 << 48) + plan[:, 1] if len(plan) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            step = plan[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - step[:, 1]
            sequence = step[:, 4] + nth // step[:, 3]
            offset = step[:, 5] + nth % step[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=PLACED.names)

    return ranked.mapInArrow(freeing(place), PLACED)


def best_fit_packing(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pack all texts of ``docs`` (null or empty: only the end id) into sequences of at most ``capacity``.

    Documents longer than the capacity are cut into whole pieces, the last may be shorter. An empty
    table gives no rows; repeated rows are packed as often as they occur; extra columns are ignored.
    """
    return pack(tokenize_pieces(docs, capacity, tokenizer), capacity)
