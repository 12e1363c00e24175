"""Operators 11 to 13 against SQL, brute force and round trips."""

import collections
import gzip
import hashlib
import io
import json
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import negatives, queries, spelling, warc

SF = "/root/testdata/sf0.001"


def rows_of(df, names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("name, table", [("op11_spelling_variants", "documents"), ("op12_hard_negatives", "embeddings"), ("op13_warc_archive", "pages")])
def test_query_equals_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got, names) == sorted(want.fetchall(), key=repr)


# --- spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_variants(docs):
    import re

    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: x if x and words[x] >= 10 * words[w] else None for w, x in best.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def test_variants_against_all_pairs(spark):
    """Made-up words with every kind of edit at every place, accents in both cases, chains of forms, ties, repeats and nulls."""
    r = random.Random(11)
    letters = "abcdefgzéÉ÷ÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 11))) for _ in range(25)]
    bag = []
    for w in base:
        n = r.choice([3, 40, 500])
        bag += [w] * n
        for _ in range(6):
            i, kind = r.randrange(len(w) + 1), r.choice("idr")
            x = w[:i] + r.choice(letters) + w[i:] if kind == "i" else w[:i] + w[i + 1 :] if kind == "d" else w[:i] + r.choice(letters) + w[i + 1 :]
            bag += [x] * r.choice([1, 2, 4])
            bag += [x[:1] + x] * 2
    bag += ["chainaaaa"] * 2 + ["chainaaab"] * 25 + ["chainaabb"] * 300 + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 3 + ["ZEBRAfish", "zebrafish"] * 2
    r.shuffle(bag)
    docs = [(i, " ".join(bag[a : a + 200]) + ", 12-x") for i, a in enumerate(range(0, len(bag), 200))]
    docs += [(900, None), (901, ""), (None, "nulliden nulliden twosies"), (3, docs[3][1]), (902, "q" * 30_000 + " " + "q" * 29_999 + " " + "q" * 30_000 + " " + "q" * 29_999)]
    frame = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n int, word string")
    got = {tuple(o) for o in spelling.spelling_variants(frame).select(*COLUMNS).collect()}
    want = slow_variants(docs)
    assert got == want and sum(o[3] is not None for o in want) > 20 and any(o[3] and o[5] != o[3] for o in want)
    empty = spelling.spelling_variants(frame.limit(0))
    assert empty.count() == 0 and empty.columns == list(COLUMNS)


def test_masks_flip_at_most_two_bits(spark):
    words = spark.createDataFrame([("balloon", 3), ("baloonéx", 2), ("ballxxn", 2)], "word string, n long")
    bands = spelling.balanced_bands(words)
    assert sorted(c for b in bands for c in b) == sorted(spelling.LETTERS) and max(map(len, bands)) == 30
    for r in words.select("word", *[spelling.parity_mask(F.col("word"), b).alias(f"m{k}") for k, b in enumerate(bands)]).collect():
        for k, b in enumerate(bands):
            assert r[f"m{k}"] == sum(1 << bit for c, bit in b.items() if r["word"].count(chr(c)) % 2)


# --- hard negatives


def slow_negatives(rows):
    import math

    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
    out = set()
    for a, (label, v) in own.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in own.items() if i != a}
        for p in sorted((i for i in score if own[i][0] == label), key=lambda i: (-score[i], i))[:5]:
            fit = sorted((i for i in score if own[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]), key=lambda i: (-score[i], i))[:10]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit, 1)}
    return out


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("dims", [1, 5, 16])
def test_negatives_against_all_products(spark, monkeypatch, dims):
    """Several blocks of rows and anchors, a vector that a third of the rows share, ties, odd dimensions, nulls and infinities."""
    monkeypatch.setattr(negatives, "LEAST_ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    r = np.random.default_rng(dims)
    hot = r.normal(0, 0.2, dims)
    rows = []
    for i in range(1200):
        v = hot if i % 3 == 0 else r.normal(0, 0.2, dims) if i % 2 else np.round(r.normal(0, 0.2, dims), 1)
        rows.append((i - 200, int(r.integers(0, 10)), [float(x) for x in v]))
    for at, bad in ((5, None), (6, [None] * dims), (7, [float("nan")] * dims), (8, [float("inf")] * dims), (9, rows[9][2])):
        rows[at] = (rows[at][0], None if at == 9 else rows[at][1], bad)
    rows += [rows[300], (None, 1, rows[0][2])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, label int, embedding array<double>, rank int").repartition(3)
    got = negatives.hard_negatives(frame)
    assert got.columns == list(MINED) and dict(got.dtypes)["rank"] == "int"
    want = slow_negatives(rows)
    found = [tuple(o) for o in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_negatives_of_odd_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert negatives.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    lone = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 2, [1.0, 1.0]), (2, 2, [1.0]), (3, 2, [1e30, 1.0])], kind)
    assert negatives.hard_negatives(lone).count() == 0  # an anchor without positives
    pair = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [1.0, 1.0]), (2, 3, [0.5, 3.0]), (4, 3, [0.5, 3.0]), (4, 3, [0.5, 3.0])], kind)
    got = [tuple(o) for o in negatives.hard_negatives(pair).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 4, 65536, 32768)]


def test_bounds_hold_every_product():
    r = np.random.default_rng(2)
    x, q = r.integers(-300, 300, (500, 7)), r.integers(-300, 300, (9, 7))
    lower, upper = negatives.Approximation(x).bounds(q, slice(0, 500))
    exact = q @ x.T
    assert (lower <= exact).all() and (exact <= upper).all() and (upper - lower).mean() < 0.5 * (exact.max() - exact.min())


# --- WARC


def read_plain(data):
    return list(warc.records(io.BufferedReader(io.BytesIO(data)), False))


PLAIN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:b>\r\nWARC-Target-URI: http://x/\r\n  folded\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 49\r\n\r\n"
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nWARC/\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
)


def test_plain_and_zipped_records(tmp_path):
    got = read_plain(PLAIN)
    assert [(g["warc_type"], g["record_id"], g["payload"], g["payload_length"]) for g in got] == [("warcinfo", "<urn:a>", b"hello", 5), ("response", "<urn:b>", b"WARC/", 5), ("metadata", None, b"", 0)]
    assert got[1]["target_uri"] == "http://x/ folded" and got[1]["offset"] == PLAIN.index(b"WARC/1.0\r\nwarc-type")
    cuts = [g["offset"] for g in got] + [len(PLAIN)]
    foreign = b"".join(gzip.compress(PLAIN[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))  # members without their length
    again = list(warc.records(io.BufferedReader(io.BytesIO(foreign)), True))
    keep = ("warc_type", "record_id", "payload", "headers", "payload_length")
    assert [[g[k] for k in keep] for g in again] == [[g[k] for k in keep] for g in got]
    for zipped, data in ((False, PLAIN), (True, foreign)):
        only = list(warc.records(io.BufferedReader(io.BytesIO(data)), zipped, [lambda r: r["warc_type"] == "metadata"]))
        assert [g["warc_type"] for g in only] == ["metadata"]
    assert list(warc.records(io.BufferedReader(io.BytesIO(b"")), True)) == [] and read_plain(b"") == []
    for broken in (PLAIN[:200], b"no archive at all\r\n\r\n"):
        with pytest.raises(ValueError, match="WARC record|cut off"):
            read_plain(broken)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BufferedReader(io.BytesIO(foreign[:-60])), True))


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    """With the length in the member a turned-down record costs its head only."""
    body = random.Random(3).randbytes(3_000_000)
    data = b"".join(warc.member([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{i}>")], body if kind == "resource" else b"x", 1) for i, kind in enumerate(("resource", "metadata", "resource", "metadata")))
    assert gzip.decompress(data).count(b"WARC/1.1") == 4  # an ordinary gzip file too
    inflated = []
    more = warc.Member._more
    monkeypatch.setattr(warc.Member, "_more", lambda self, most=1 << 14: inflated.append(most) or more(self, most))
    got = list(warc.records(io.BufferedReader(io.BytesIO(data)), True, [lambda r: r["warc_type"] == "metadata"]))
    assert [g["payload"] for g in got] == [b"x", b"x"] and sum(inflated) < 200_000
    every = list(warc.records(io.BufferedReader(io.BytesIO(data)), True, payloads=False, lengths=False))
    assert len(every) == 4 and sum(inflated) < 500_000


def archive(spark, rows, path, **options):
    df = spark.createDataFrame(rows, "record_id string, warc_type string, target_uri string, payload binary, extra int")
    warc.write_warc(df, path, **options)


def test_source_pushes_down_and_prunes(spark, tmp_path):
    path = str(tmp_path / "a")
    archive(spark, [(f"<urn:{i}>", "resource" if i % 2 else "metadata", f"http://h{i % 3}/", bytes([i]) * 50_000, 1) for i in range(40)], path, file_bytes=4000)
    archive(spark, [("<urn:late>", "resource", None, None, 1)], path)
    df = warc.read_warc(spark, path, pushdown=True, split_bytes=8000)
    assert df.rdd.getNumPartitions() > 1 and set(df.columns) >= {"record_id", "headers", "payload", "file", "offset"}
    found = df.where("warc_type = 'resource' AND target_uri LIKE 'http://h1%' AND record_id IN ('<urn:1>', '<urn:7>', '<urn:8>') AND content_length > 10")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["record_id"], len(r["payload"]), r["payload"][0]) for r in found.collect()) == [("<urn:1>", 50_000, 1), ("<urn:7>", 50_000, 7)]
    assert "Filter" not in plan.split("BatchScan")[0], plan
    either = df.where("warc_type = 'metadata' OR payload IS NULL").select("record_id")
    assert either.count() == 20
    heads = warc.read_warc(spark, path, "record_id string, payload_length long", pushdown=True)
    assert heads.where("record_id = '<urn:late>'").collect() == [("<urn:late>", 0)] and heads.count() == 41 + df.where("warc_type = 'warcinfo'").count()
    some = df.where("warc_type = 'resource'")
    assert (some.count(), df.count(), df.where("warc_type = 'metadata'").count(), df.count()) == (21, heads.count(), 20, heads.count())  # no predicate stays for the next query
    plain = warc.read_warc(spark, path, "record_id string, warc_type string")
    some = plain.where("warc_type = 'resource'")
    assert plain.union(some).count() == heads.count() + 21 and plain.join(some, "record_id", "left_anti").count() == heads.count() - 21
    told = warc.read_warc(spark, path, "record_id string, payload binary", [("warc_type", "=", "resource"), ("target_uri", "prefix", "http://h1"), ("content_length", ">=", 10), ("refers_to", "null", None)])
    assert sorted(r["record_id"] for r in told.collect()) == sorted(f"<urn:{i}>" for i in range(40) if i % 2 and i % 3 == 1)
    assert df.where("target_uri IS NULL AND warc_type <> 'warcinfo'").count() == 1
    archive(spark, [("<urn:new>", "resource", "u", b"n", 1)], path, mode="overwrite")
    assert [r["record_id"] for r in warc.read_warc(spark, path).where("warc_type = 'resource'").collect()] == ["<urn:new>"]
    assert len(list((tmp_path / "a").glob("*.gz"))) == 1


def test_leftovers_of_lost_tasks_are_not_read(spark, tmp_path):
    path = tmp_path / "b"
    archive(spark, [("<urn:1>", "resource", "u", b"p", 1)], str(path))
    (path / "orphan.warc.gz").write_bytes(b"half a file")
    (path / "_manifests" / "x.draft").write_text("[")
    assert warc.read_warc(spark, str(path)).where("warc_type = 'resource'").count() == 1
    assert json.loads((path / "_manifests" / "000000000001.json").read_text())[0]["records"] == 2
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "plain.warc").write_bytes(PLAIN)
    assert warc.read_warc(spark, f"file://{tmp_path}/c").count() == 3  # without manifests every archive counts


PAGED = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_pages_come_back(spark):
    long, copy = "é<p>" * 300_000, "same text 中 " * 20
    pages = [(5, "u5", copy), (3, "u3\r\nX: y", copy), (9, None, copy), (4, "u4", "short"), (1, "u1", "short"), (7, "u", None), (8, "", ""), (2, "WARC/1.1", long), (10, "v", "x" * 99), (11, "v", "x" * 99), (12, "v", "y" * 100), (13, "v", "y" * 100)]
    pages += [(3, "again", copy), (None, "n", copy), (None, "n", "z" * 200), (None, "n", "z" * 200), (20, "r", "HTTP/1.1 200 OK\r\n\r\n" * 10), (21, "r", "HTTP/1.1 200 OK\r\n\r\n" * 10)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    got = rows_of(warc.archived_pages(frame), PAGED)
    first = collections.defaultdict(list)
    for i, _, t in pages:
        first[t].append(i)
    want = []
    for i, _, t in pages:
        raw = (t or "").encode()
        ids = [x for x in first[t] if x is not None]
        again = len(raw) >= 100 and bool(ids) and i != min(ids)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archived_pages(frame.limit(0)).count() == 0
