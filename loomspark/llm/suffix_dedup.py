"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A later copy of a whole text is taken out first. Of the others only suffixes that can tie over
``length`` bytes are ever sorted:

1. Every window of ``length`` bytes names an anchor, the least hashed ``GRAM``-byte string in it, so
   equal windows name equal anchors at equal offsets. Anchors go to blocks by their hash. An anchor
   whose whole surroundings (all windows that can name it) occur in an earlier document settles
   itself by 88 bits of hashes; copies and the inside of shared passages end here.
2. The rest, at the edges of shared passages, ask for their surroundings. In a block of them the
   suffixes are dealt to buckets by their leading byte and one bucket at a time is sorted: by the
   leading 16 bytes, and long ties by the precomputed ranks of a cover sample. Samples stand at the
   positions of a difference cover modulo 16, so a few ranks serve the suffixes of every offset.
   Equal suffixes are compared once more byte by byte.
3. An anchor with very many different surroundings in one block of text is not collected: its
   windows are spread by their own 128 hash bits instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, materialize, row_slices, text_buffers, text_bytes

GRAM = 18
#: Text bytes for each bucket; bytes of a block; different surroundings that make an anchor hot.
BUCKET_BYTES, BLOCK_BYTES, HOT = 24 << 20, 4 << 20, 48
#: A difference cover modulo 16: every difference is one of two members.
MODULUS, COVER = 16, (0, 1, 2, 5, 8)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
#: What becomes of an anchor: it is settled, or its surroundings (or, of a hot one, its windows) are asked for.
SETTLED, ASKED, HOT_ASKED = 0, 1, 2
MARK = "doc_id long, kind int, anchor long, at long"
_SPAN = np.dtype([("a", "<i8"), ("b", "<i8")])
_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("at", "<i8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C1
    x = (x ^ (x >> np.uint64(29))) * _C2
    return x ^ (x >> np.uint64(32))


def _rolled(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes from each position (the last n - 1 positions are of no use)."""
    base, power = int(_C2), 1
    part, width = _BYTE[raw], 1
    out, have = None, 0
    while True:
        if n & width:
            if out is None:
                out, have = part.copy(), width
            else:  # append the part behind what is there
                out[: len(out) - have] = out[: len(out) - have] * np.uint64(pow(base, width, 1 << 64)) + part[have:]
                have += width
        if 2 * width > n:
            return _mix(out)
        power = pow(base, width, 1 << 64)
        nxt = part * np.uint64(power)
        nxt[: len(nxt) - width] += part[width:]
        part, width = nxt, 2 * width


def _slide(x: np.ndarray, n: int, of, backwards: bool = False) -> np.ndarray:
    """``of`` (minimum or maximum) over x[i : i + n], or over x[i - n + 1 : i + 1]."""
    out, width = x.copy(), 1
    while width < n:
        step = min(width, n - width)
        if backwards:
            out[step:] = of(out[step:], out[:-step].copy())
        else:
            out[:-step] = of(out[:-step].copy(), out[step:])
        width += step
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``raw`` of the anchors of all windows, and all positions' hashes."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _rolled(raw, GRAM)
    order = (h >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    left = ends - np.arange(n)  # bytes of the document from here on
    order[left < GRAM] = np.uint32(0xFFFFFFFF)
    windows = length - GRAM + 1
    least = _slide(order, windows, np.minimum)
    least[left < length] = 0
    most = _slide(least, windows, np.maximum, backwards=True)
    return np.flatnonzero((order == most) & (left >= GRAM)), h


def surroundings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int, width: int) -> np.ndarray:
    """One row of ``width`` bytes for each anchor: all that windows naming it can hold, zero outside the document."""
    before = length - GRAM
    pad = np.concatenate([np.zeros(before, np.uint8), raw, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(pad, width)[at].copy()
    col = np.arange(width)
    edge = np.flatnonzero((at - before < starts) | (at + length > ends))
    place = at[edge, None] - before + col[None, :]
    rows[edge] = np.where((place >= starts[edge, None]) & (place < ends[edge, None]), rows[edge], 0)
    rows[:, before + length :] = 0
    return rows


def _row_hash(rows: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    h = lefts.astype(np.uint64) * _C1 + rights.astype(np.uint64)
    for col in np.ascontiguousarray(rows).view("<u8").T:
        h = (h ^ col) * _C2
        h ^= h >> np.uint64(29)
    return _mix(h)


def _runs(sorted_equal: np.ndarray) -> np.ndarray:
    """For each row the index of the first row of its run; ``sorted_equal[i]``: row i equals row i - 1."""
    first = np.where(sorted_equal, 0, np.arange(len(sorted_equal)))
    return np.maximum.accumulate(first)


def _pack(anchor: np.ndarray, body: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    """Anchors of one block and bucket: 6 + 5 bytes of hashes, a position, and a document of a short list."""
    docs, index = np.unique(doc, return_inverse=True)
    wide = len(docs) > 65535 or (len(at) and at.max() >= 1 << 32)
    head = np.array([len(anchor), len(docs), wide], "<i8")
    cut = lambda x, n: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :]).tobytes()
    return head.tobytes() + docs.astype("<i8").tobytes() + cut(anchor, 6) + cut(body, 5) + index.astype("<u4" if wide else "<u2").tobytes() + at.astype("<i8" if wide else "<u4").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, k, wide = np.frombuffer(blob, "<i8", 3).tolist()
    docs = np.frombuffer(blob, "<i8", k, 24)
    spot = 24 + 8 * k

    def grown(size: int) -> np.ndarray:
        nonlocal spot
        out = np.zeros((n, 8), np.uint8)
        out[:, 8 - size :] = np.frombuffer(blob, np.uint8, n * size, spot).reshape(n, size)
        spot += n * size
        return out.view("<u8").ravel()

    anchor, body = grown(6), grown(5)
    index = np.frombuffer(blob, "<u4" if wide else "<u2", n, spot)
    spot += n * index.itemsize
    return anchor, body, docs[index], np.frombuffer(blob, "<i8" if wide else "<u4", n, spot).astype(np.int64)


def _by_doc(doc: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    yield from zip(doc[np.concatenate([[0], cuts])].tolist() if len(doc) else [], *[np.split(v[order], cuts) for v in values], strict=True) if len(doc) else ()


def _settle(anchor: np.ndarray, body: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order (anchor, body, doc); is the row settled by an earlier document; start of its body's run."""
    order = np.lexsort((doc, body, anchor))
    a, b, d = anchor[order], body[order], doc[order]
    same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])]) if len(a) else np.zeros(0, bool)
    first = _runs(same)
    return order, d > d[first] if len(d) else np.zeros(0, bool), same


MAPPED = "bucket int, doc_ids array<long>, kinds array<int>, anchors array<long>, ats array<long>, hot binary, entries binary"
#: Marks in a row that a block of text passes on.
MARKS_PER_ROW = 4096


def _runs_of(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each distinct value; one sort, however many values there may be."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for own in np.split(order, cuts) if len(order) else ():
        yield int(values[own[0]]), own


def _map_blocks(length: int, buckets: int, block_bytes: int, most: int):
    width = -(-(2 * length - GRAM) // 8) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in row_slices(offsets, block_bytes):
                part, here = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                at, h = anchors(part, here, length)
                if not len(at):
                    continue
                row = np.searchsorted(here, at, side="right") - 1
                starts, ends, doc = here[row], here[row + 1], ids[a:b][row]
                anchor = h[at]
                around = surroundings(part, starts, ends, at, length, width)
                lefts, rights = np.minimum(at - starts, length - GRAM), np.minimum(ends - at, length)
                body = _row_hash(around, lefts, rights)
                del around, h
                order, settled, same = _settle(anchor, body, doc)
                new_anchor = np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])
                group = np.cumsum(new_anchor) - 1
                hot = (np.bincount(group, weights=~same) > most)[group]
                place = (at - starts)[order]
                d, an, bo = doc[order], anchor[order], body[order]
                rows = []
                marked = np.flatnonzero(settled | hot)
                for i in range(0, len(marked), MARKS_PER_ROW):
                    own = marked[i : i + MARKS_PER_ROW]
                    kinds = np.where(settled[own], SETTLED, HOT_ASKED)
                    rows.append((-1 - (i + a) % buckets, d[own], kinds, np.where(settled[own], 0, an[own].view(np.int64)), place[own], None, None))
                # One entry of a hot anchor stays, so that its bucket learns of it and turns the others over as well.
                kept = ~settled & (~hot | new_anchor)
                an, bo, d, place, mark = an[kept], bo[kept], d[kept], place[kept], hot[kept]
                for k, own in _runs_of((an % np.uint64(buckets)).astype(np.int64)):
                    plain = own[~mark[own]]
                    blob = _pack(an[plain], bo[plain], d[plain], place[plain]) if len(plain) else None
                    # Of an anchor six bytes are sent; the mark of a hot one travels apart.
                    rows.append((k, None, None, None, None, np.ascontiguousarray(an[own[mark[own]]] & ~np.uint64(0xFFFF)).astype("<u8").tobytes(), blob))
                kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MAPPED.split(", ")])

    return run


def _settle_buckets(most: int):
    def run(t: pa.Table) -> pa.Table:
        """One bucket: settles anchors by their surroundings and asks for those that stay open; a row for each mark."""
        out = [pa.table([pa.array([], x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["doc_id", "kind", "anchor", "at"])]
        marks = b"".join(x for x in t.column("hot").to_pylist() if x)
        blobs = [x for x in t.column("entries").to_pylist() if x]
        if t.column("doc_ids").null_count < t.num_rows:
            passed = [pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in [t.column(n)]]).drop_null().flatten() for n in ("doc_ids", "kinds", "anchors", "ats")]
            out.append(pa.table(passed, names=out[0].column_names))
        if blobs:
            anchor, body, doc, at = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
            blobs.clear()
            order, settled, same = _settle(anchor, body, doc)
            anchor, doc, at = anchor[order], doc[order], at[order]
            new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            group = np.cumsum(new) - 1
            bodies = np.bincount(group, weights=~same)
            firsts = np.flatnonzero(new)
            least, largest = np.minimum.reduceat(doc, firsts), np.maximum.reduceat(doc, firsts)
            hot = np.isin(anchor[new], np.frombuffer(marks, "<u8")) | (bodies > most * 100)
            open_ = ~settled & (hot | ((bodies > 1) & (least < largest)))[group]
            told = settled | open_
            kind = np.where(settled, SETTLED, np.where(hot[group], HOT_ASKED, ASKED))[told]
            out.append(pa.table([pa.array(doc[told]), pa.array(kind, pa.int32()), pa.array(np.where(kind == SETTLED, 0, anchor[told].view(np.int64))), pa.array(at[told])], names=out[0].column_names))
        return pa.concat_tables(out)

    return run


def _pairs(asks: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (anchor, place) of a list of structs, as far as they lie in a text of ``n`` bytes."""
    every = asks.values if asks.is_valid else None
    if every is None or not len(every):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    anchor, at = (np.asarray(every.field(k)).astype(np.int64) for k in ("anchor", "at"))
    order = np.lexsort((anchor, at))
    anchor, at = anchor[order], at[order]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1])]) & (at + GRAM <= n)
    return anchor[new].view(np.uint64), at[new]


def _answer(length: int, buckets: int):
    """Each document sends the surroundings asked for, by anchor; hot anchors' windows, by window."""
    width = -(-(2 * length - GRAM) // 8) * 8
    kind = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("left", "<i2"), ("right", "<i2"), ("text", "u1", width)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            found: dict[int, list[bytes]] = {}
            windows: dict[int, list[bytes]] = {}
            for i, doc in enumerate(batch.column(0).to_pylist()):
                part = raw[offsets[i] : offsets[i + 1]]
                n = len(part)
                (anchor, at), hot = _pairs(batch.column(2)[i], n), _pairs(batch.column(3)[i], n)[1]
                if len(at):
                    rows = np.zeros(len(at), kind)
                    rows["anchor"], rows["doc"], rows["at"] = anchor, doc, at
                    rows["left"], rows["right"] = np.minimum(at, length - GRAM), np.minimum(n - at, length)
                    rows["text"] = surroundings(part, np.zeros(len(at), np.int64), np.full(len(at), n), at, length, width)
                    for k, own in _runs_of(((anchor >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)):
                        found.setdefault(k, []).append(rows[own].tobytes())
                if len(hot):
                    starts = np.unique((hot[:, None] - np.arange(length - GRAM + 1)[None, :]).ravel())
                    starts = starts[(starts >= 0) & (starts + length <= n)]
                    own = np.zeros(len(starts), _WINDOW)
                    own["doc"], own["at"] = doc, starts
                    own["h1"] = _rolled(part, length)[starts]
                    own["h2"] = _mix(_rolled(part[::-1], length)[n - length - starts])
                    for k, mine in _runs_of((own["h1"] % np.uint64(buckets)).astype(np.int64)):
                        windows.setdefault(k, []).append(own[mine].tobytes())
            out = [(k, b"".join(v), None) for k, v in found.items()] + [(-1 - k, None, b"".join(v)) for k, v in windows.items()]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "found", "windows"])

    return run, kind


def _ranks(columns: np.ndarray) -> np.ndarray:
    """Order-preserving ranks of the rows of 8-byte big-endian columns."""
    rank = np.unique(columns[:, 0], return_inverse=True)[1].astype(np.uint64)
    for c in columns.T[1:]:
        nxt = np.unique(c, return_inverse=True)[1].astype(np.uint64)
        rank = np.unique(rank * np.uint64(len(rank) + 1) + nxt, return_inverse=True)[1].astype(np.uint64)
    return rank


def sort_suffixes(text: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window offset of each row that an earlier document's row ties with (-1: none).

    Every window offset of a row begins a suffix. Suffixes are dealt to buckets by their leading byte,
    and one bucket at a time is sorted by the leading 16 bytes. What still ties is ordered by the rank
    of the cover sample inside, which spans the middle, and by the last 16 bytes; row positions are
    aligned modulo ``MODULUS``, so suffixes of one offset find their sample at the same distance, and
    suffixes of different offsets name different anchors. Neighbours that tie throughout are verified
    byte by byte against the earliest of them.
    """
    before, n = length - GRAM, len(text)
    middle = length - MODULUS + 1
    offsets = before + 1
    wide = np.concatenate([text, np.zeros((n, 16), np.uint8)], 1)
    step = np.array([next(d for d in range(MODULUS) if (o + d) % MODULUS in COVER) for o in range(offsets)])
    samples = np.unique(np.arange(offsets) + step)
    ranks = np.zeros((len(samples), n), np.uint32)
    for i, at in enumerate(samples):
        cell = np.zeros((n, -(-middle // 8) * 8), np.uint8)
        cell[:, :middle] = wide[:, at : at + middle]
        ranks[i] = _ranks(cell.view(">u8").astype(np.uint64))
    sample_of = np.searchsorted(samples, np.arange(offsets) + step)
    ends = np.lib.stride_tricks.sliding_window_view(wide, 16, axis=1)
    whole = np.lib.stride_tricks.sliding_window_view(wide, length, axis=1)
    spots = np.arange(offsets)[None, :]
    there = np.flatnonzero((before - left[:, None] <= spots) & (spots + length <= before + right[:, None]))
    lead = wide[there // offsets, there % offsets]
    first, last = np.full(n, offsets), np.full(n, -1)
    for _, own in _runs_of(lead.astype(np.int64)):
        r, o = there[own] // offsets, there[own] % offsets
        head = ends[r, o].view(">u8").astype(np.uint64)
        order = np.lexsort((head[:, 1], head[:, 0]))
        tied = np.zeros(len(order), bool)
        tied[1:] = (head[order][1:] == head[order][:-1]).all(1)
        group = np.cumsum(~tied)
        both = tied | np.append(tied[1:], False)
        r, o, group = r[order][both], o[order][both], group[both]
        if not len(r):
            continue
        tail = ends[r, o + length - 16].view(">u8").astype(np.uint64)
        rank = ranks[sample_of[o], r]
        order = np.lexsort((doc[r], tail[:, 1], tail[:, 0], rank, o, group))
        r, o, group, tail, rank = r[order], o[order], group[order], tail[order], rank[order]
        tied = np.zeros(len(r), bool)
        tied[1:] = (group[1:] == group[:-1]) & (o[1:] == o[:-1]) & (rank[1:] == rank[:-1]) & (tail[1:] == tail[:-1]).all(1)
        run = _runs(tied)
        hit = np.flatnonzero(doc[r] > doc[r[run]])
        hit = hit[(whole[r[hit], o[hit]] == whole[r[run[hit]], o[run[hit]]]).all(1)]
        np.minimum.at(first, r[hit], o[hit])
        np.maximum.at(last, r[hit], o[hit])
    return np.where(last < 0, -1, first), last


def _sort_bucket(length: int, kind: np.dtype):
    def run(t: pa.Table) -> pa.Table:
        before = length - GRAM
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        found = b"".join(x for x in t.column("found").to_pylist() if x)
        windows = b"".join(x for x in t.column("windows").to_pylist() if x)
        rows = np.frombuffer(found, kind)
        if len(rows):
            first, last = sort_suffixes(rows["text"], rows["doc"], rows["left"], rows["right"], length)
            hit = first >= 0
            spans = np.zeros(int(hit.sum()), _SPAN)
            spans["a"], spans["b"] = rows["at"][hit] - before + first[hit], rows["at"][hit] - before + last[hit] + length
            parts.append((rows["doc"][hit], spans))
        own = np.frombuffer(windows, _WINDOW)
        if len(own):
            order = np.lexsort((own["doc"], own["h2"], own["h1"]))
            own = own[order]
            run_ = _runs(np.concatenate([[False], (own["h1"][1:] == own["h1"][:-1]) & (own["h2"][1:] == own["h2"][:-1])]))
            hit = own["doc"] > own["doc"][run_]
            spans = np.zeros(int(hit.sum()), _SPAN)
            spans["a"], spans["b"] = own["at"][hit], own["at"][hit] + length
            parts.append((own["doc"][hit], spans))
        out = [(k, v.tobytes()) for doc, spans in parts for k, v in _by_doc(doc, spans)]
        cols = list(zip(*out, strict=True)) or [()] * 2
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.binary()), strict=True)], names=["doc_id", "spans"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            out = []
            for i, (marks, spans, copy) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                part = raw[offsets[i] : offsets[i + 1]]
                n = len(part)
                edge = np.zeros(n + 1, np.int64)
                if marks.is_valid:
                    at = np.asarray(marks.values).astype(np.int64)
                    at = at[at < n]
                    np.add.at(edge, np.maximum(at - (length - GRAM), 0), 1)
                    np.add.at(edge, np.minimum(at + length, n), -1)
                for x in spans or ():
                    s = np.frombuffer(x, _SPAN)
                    s = s[s["a"] < n]
                    np.add.at(edge, s["a"], 1)
                    np.add.at(edge, np.minimum(s["b"], n), -1)
                gone = edge[:-1].cumsum() > 0 if not copy else np.full(n, n >= length)
                runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                out.append((n, int(gone.sum()), runs, hashlib.sha256(part[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def repeated_passages(docs: DataFrame, length: int = 50, bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): bytes, removed bytes and runs, digest of the rest.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller
    doc_id. A null text is empty; rows of one doc_id are one document, so repeated rows remove nothing
    from each other and give equal results; a null doc_id takes no part. An empty table gives no
    rows, texts of any length are taken whole, and extra columns are ignored. ``length`` is at least 48,
    so that two ends and a sample span it.
    """
    if length < 3 * MODULUS:
        raise ValueError(f"length is at least {3 * MODULUS}")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A later copy of a whole text goes as one, and whatever it holds the first one holds as well.
    body = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    keys = source.where("doc_id is not null and text is not null").select("doc_id", *body)
    firsts = keys.groupBy(*("h1", "h2")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    texts = keys.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("texts"))  # rows of one id with different texts are no copies
    copies = keys.join(firsts, ["h1", "h2"]).where("doc_id > first").select("doc_id").distinct().join(texts, "doc_id").where("texts = 1")
    copies = broadcast_if_few(materialize(copies.select(F.col("doc_id").alias("copy")), "copies"))
    keyed = source.where("doc_id is not null").join(copies, F.col("doc_id") == F.col("copy"), "left").select("doc_id", "text", F.col("copy").isNotNull().alias("copy"))
    own = keyed.where("not copy").select("doc_id", "text")
    buckets = max(1, -(-text_bytes(source) // bucket_bytes))
    mapped = own.mapInArrow(_map_blocks(length, buckets, block_bytes, hot), MAPPED)
    settled = materialize(mapped.groupBy("bucket").applyInArrow(_settle_buckets(hot), MARK), "marks")
    spots = settled.where(f"kind = {SETTLED}").groupBy("doc_id").agg(F.collect_list("at").alias("spots"))
    ask = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("anchor", "at")))
    asking = settled.where(f"kind <> {SETTLED}").groupBy(F.col("doc_id").alias("k")).agg(ask(ASKED).alias("asks"), ask(HOT_ASKED).alias("hot"))
    answer, kind = _answer(length, buckets)
    answers = own.join(asking.hint("shuffle_hash"), F.col("doc_id") == F.col("k")).select("doc_id", "text", "asks", "hot").mapInArrow(answer, "bucket int, found binary, windows binary")
    spans = answers.groupBy("bucket").applyInArrow(_sort_bucket(length, kind), "doc_id long, spans binary").groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    named = lambda df: df.withColumnRenamed("doc_id", "k").hint("shuffle_hash")
    marked = keyed.join(named(spots), F.col("doc_id") == F.col("k"), "left").drop("k").join(named(spans), F.col("doc_id") == F.col("k"), "left").select("doc_id", "text", "spots", "spans", "copy")
    without = source.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("spots"), F.lit(None).cast("array<binary>").alias("spans"), F.lit(False).alias("copy"))
    return marked.mapInArrow(_cut(length), SCHEMA).unionAll(without.mapInArrow(_cut(length), SCHEMA))
