"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree of order 3: counts of the byte that follows
every context seen in training. A byte not seen after a context is coded by the escape probability
(method C: distinct / (total + distinct)) times the next shorter context's distribution over the
bytes that are left, down to the uniform order -1. Statistics are frozen after training, so the
code length of a byte depends on its three predecessors only; the lengths of all that was seen, and of
the escapes, are worked out once, and scoring a text is an exact sum of table entries. The language
with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, text_buffers

UNDETERMINED = "und"

def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class _Keys:
    """The places of 64-bit keys in a list without repeats, by open addressing; -1 for a key that is not in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(3 * len(keys) + 1)))))
        self.slots = np.full(1 << int(64 - int(self.shift)), -1, np.int32)
        self.steps = 0
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = self._slot(self.keys[left], self.steps)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several keys for one slot the last one stays
            left = left[self.slots[at] != left]
            self.steps += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift) + np.uint64(step)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for step in range(self.steps):
            own = keys if step == 0 else keys[left]
            place = self.slots[self._slot(own, step)]
            right = (place >= 0) & (self.keys[place] == own)
            out[left[right]] = place[right]
            left = left[(place >= 0) & ~right]
            if not len(left):
                break
        return out


@dataclass
class PpmModel:
    """Code lengths of all symbols that were seen after a context in any language, and of escapes, by order.

    ``seen[k]`` and ``bits[k]``: strings of k + 1 symbols and the bits of the last one for each language;
    ``contexts[k]`` and ``escapes[k]``: strings of k symbols and the bits of leaving them. Only what
    the training texts hold is stored, so the size is bounded by the training sample.
    """

    languages: list[str]
    symbols: np.ndarray
    size: int
    first: np.ndarray
    seen: dict[int, _Keys]
    bits: dict[int, np.ndarray]
    contexts: dict[int, _Keys]
    escapes: dict[int, np.ndarray]
    unseen_bits: float

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
        """Bits that each language's tree needs for each row, ``chunk`` bytes at a time, however long a row is."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for lo in range(0, len(raw), chunk):
            hi = min(lo + chunk, len(raw))
            back = min(lo, 3)
            sym = self.symbols[raw[lo - back : hi]].astype(np.uint64)
            rows = np.arange(np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left"))
            rows = rows[(np.minimum(offsets[rows + 1], hi) > np.maximum(offsets[rows], lo))]
            at = np.arange(lo, hi) - np.repeat(offsets[rows], np.minimum(offsets[rows + 1], hi) - np.maximum(offsets[rows], lo))
            context = np.zeros(hi - lo, np.uint64)
            keys = {}
            for k in (1, 2, 3):
                prev = np.zeros(hi - lo, np.uint64)
                skip = max(0, k - back)
                prev[skip:] = sym[back - k + skip : len(sym) - k]
                prev[at < k] = 0
                context = context + prev * np.uint64(self.size ** (k - 1))
                keys[k] = context
            own = sym[back:]
            bits = self._look_up(keys, own)
            starts = np.maximum(offsets[rows], lo) - lo
            out[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
            if self.unseen_bits:
                out[rows] += (np.add.reduceat(own == 0, starts, dtype=np.int64) * self.unseen_bits)[:, None]
        return out

    def _look_up(self, contexts: dict[int, np.ndarray], sym: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(sym), len(self.languages)), np.float32)
        left = np.arange(len(sym))
        for k in (3, 2):
            place = self.seen[k].find(contexts[k][left] * np.uint64(self.size) + sym[left])
            hit = place >= 0
            bits[left[hit]] += self.bits[k][place[hit]]
            left = left[~hit]
            place = self.contexts[k].find(contexts[k][left])
            bits[left] += self.escapes[k][place]  # the last row, for a context never seen, is zero
        bits[left] += self.first[contexts[1][left].astype(np.int64) * self.size + sym[left].astype(np.int64)]
        return bits


def _mix(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Method-C distributions of contexts (rows of counts) over the shorter contexts' ones."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    left = np.where(counts > 0, 0, lower)
    rest = left.sum(1, keepdims=True)
    escape = np.where(rest > 1e-12, distinct, 0)
    share = np.divide(left, rest, out=np.zeros_like(left), where=rest > 1e-12)
    mixed = (counts + escape * share) / np.maximum(total + escape, 1)
    return np.where(total > 0, mixed, lower)


def train_ppm(samples: dict[str, list[bytes]]) -> PpmModel:
    """Trees of all languages from their sample texts; a byte that no sample holds is coded uniformly."""
    languages = sorted(samples)
    known = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            known[np.frombuffer(t, np.uint8)] = True
    symbols = np.where(known, np.cumsum(known), 0).astype(np.uint16)
    size = int(known.sum()) + 1
    uniform = np.full(size, 1 / 256)
    uniform[0] = 1 - (size - 1) / 256
    first = np.zeros((size * size, len(languages)), np.float32)
    levels: dict[int, list[tuple]] = {2: [], 3: []}
    for i, lang in enumerate(languages):
        keys = [np.zeros(0, np.int64)]
        for t in samples[lang]:
            s = np.concatenate([np.zeros(3, np.int64), symbols[np.frombuffer(t, np.uint8)].astype(np.int64)])
            keys.append(((s[:-3] * size + s[1:-2]) * size + s[2:-1]) * size + s[3:])
        grams, counts = np.unique(np.concatenate(keys), return_counts=True)
        table = lambda k, n: np.bincount(k, weights=counts, minlength=n * size).reshape(n, size)
        p0 = _mix(table(grams % size, 1), uniform[None, :])
        p1 = _mix(table(grams % size**2, size), np.repeat(p0, size, 0))
        first[:, i] = -np.log2(p1.ravel())
        lower = p1.ravel()[grams % size**2]
        for k in (2, 3):
            own, inverse = np.unique(grams % size ** (k + 1), return_inverse=True)
            n = np.bincount(inverse, weights=counts, minlength=len(own))
            short = np.zeros(len(own))
            short[inverse] = lower
            contexts, of = np.unique(own // size, return_inverse=True)
            total, distinct = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
            rest = 1 - np.bincount(of, weights=short, minlength=len(contexts))
            escape = np.where(rest > 1e-12, distinct, 0)
            p = n / (total + escape)[of]
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(rest > 1e-12, np.log2(rest) - np.log2(escape / (total + escape)), 0.0)
            levels[k].append((own, -np.log2(p), contexts, leave))
            lower = p[inverse]
    seen, bits, contexts, escapes = {}, {}, {}, {}
    for k in (2, 3):
        every = np.unique(np.concatenate([x[0] for x in levels[k]] or [np.zeros(0, np.int64)]))
        ctx = np.unique(np.concatenate([x[2] for x in levels[k]] or [np.zeros(0, np.int64)]))
        leave = np.zeros((len(ctx) + 1, len(languages)), np.float32)
        for i, (_, _, own, b) in enumerate(levels[k]):
            leave[np.searchsorted(ctx, own), i] = b
        # What one language has not seen after a context is left by its escape and coded one order lower.
        short = every % size**k
        low = bits[k - 1][np.searchsorted(seen_keys, short)] if k == 3 else first[short]
        value = leave[np.searchsorted(ctx, every // size)] + low
        for i, (own, b, _, _) in enumerate(levels[k]):
            value[np.searchsorted(every, own), i] = b
        seen[k], bits[k], contexts[k], escapes[k], seen_keys = _Keys(every), value.astype(np.float32), _Keys(ctx), leave, every
    return PpmModel(languages, symbols, size, first, seen, bits, contexts, escapes, float(np.log2(max(1, 257 - size))))


def training_sample(docs: DataFrame, per_language: int = 300, max_bytes: int = 16384) -> dict[str, list[bytes]]:
    """At most ``per_language`` labelled texts of at most ``max_bytes`` bytes for each language.

    Rows are taken in the order of a hash of the text: a filter on the hash brings them down to a
    bounded number before the only per-language window, so no language's rows meet in one task.
    """
    rows = docs.select(F.col("doc_id"), "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.octet_length("text").between(1, max_bytes) & F.col("text").rlike(r"\p{L}")
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    most = max(20, min(per_language, 4 * 300 * 4 // len(sizes)))
    place = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30))
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * most / n)))]), F.col("lang"))
    near = rows.withColumn("place", place).where(F.col("place") < share * float(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    out: dict[str, list[bytes]] = {}
    for lang, text in near.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("lang", "rank").select("lang", "text").collect():
        out.setdefault(lang, []).append(text.encode())
    return out


def identify(docs: DataFrame, model: PpmModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): language, its posterior, bits per byte, ``keep`` columns.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was
    learned. Equal code lengths go to the language that sorts first. A null doc_id is not held out.
    Repeated rows give equal results, an empty table gives no rows, a text of any length is scored
    whole in chunks, and other columns than those of ``keep`` are ignored, whatever their names.
    Only the text goes to Python; the other columns wait in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: PpmModel = shared.value
        for column in texts:
            n = len(column)
            lang, score, rate = [UNDETERMINED] * n, np.zeros(n), np.zeros(n)
            if m.languages and n:
                raw, offsets = text_buffers(column)
                bits = m.code_lengths(raw, offsets)
                best = bits.argmin(1)
                least = bits[np.arange(n), best]
                lang = [m.languages[b] for b in best]
                score, rate = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), least / np.maximum(np.diff(offsets), 1)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=["lang", "score", "rate"])
        give_back()

    # Nondeterministic to Spark, so that a filter on the result does not make it run twice.
    best = F.arrow_udf(predict, "lang string, score double, rate double").asNondeterministic()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)])
    found = rows.withColumn("_best", best("_text")).withColumn("_sure", F.coalesce(F.col("_text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages)))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.when(F.col("_sure"), F.col("_best.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("_sure"), F.col("_best.score")).otherwise(0.0).alias("score"), F.when(F.col("_sure"), F.col("_best.rate")).otherwise(0.0).alias("bits_per_byte"),
        *[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)],
    )


def language_id(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """Learn from a bounded labelled sample of ``docs`` and predict every text of ``docs``."""
    return identify(docs, train_ppm(training_sample(docs, per_language)))
