"""Each corpus operator on odd rows, on empty tables and against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from loomspark.llm import ann, decontamination, language_id, license_scan, line_dedup, packing, pii, sharding, simhash, suffix_dedup
from loomspark.llm.common import connected_components

#: Extra columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int, bucket int, k int, gone string, marks string, n long, label string, score double"


def frame(spark, texts, langs=None, ids=None):
    rows = [(i if ids is None else ids[i], t, None if langs is None else langs[i], "s", len(t or ""), 1, 2, 3, 4, "g", "m", 5, "l", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, words=120, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(words))


LONG = prose(99, 30_000)
ODD = [None, "", " ", "\n\n", "x", "é😂", prose(1), prose(1), prose(2) + "\n" + prose(3), "1234", "....", "A\tB\x0bC", LONG]
OPERATORS = [
    language_id.language_id,
    sharding.compacted_documents,
    pii.detect_pii,
    packing.best_fit_packing,
    suffix_dedup.repeated_passages,
    simhash.simhash_components,
    simhash.near_duplicates,
    line_dedup.line_dedup,
    license_scan.license_scan,
]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_odd_rows_repeated_rows_and_empty_tables(spark, operator):
    docs = frame(spark, ODD)
    out = operator(docs).collect()
    assert {r["doc_id"] for r in out} == set(range(len(ODD)))
    twice = operator(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * len(out)
    assert operator(docs.limit(0)).collect() == []


def test_null_ids_do_not_fail(spark):
    docs = frame(spark, ["some text here with words", "some text here with words", None], ids=[None, 1, None])
    for operator in (language_id.language_id, pii.detect_pii, suffix_dedup.repeated_passages, license_scan.license_scan, line_dedup.line_dedup, sharding.compacted_documents, packing.best_fit_packing):
        assert len(operator(docs).collect()) == 3


# --- language identification


def test_code_lengths_are_those_of_a_distribution():
    m = language_id.train_ppm({"a": [b"abracadabra abra", b"cad"], "b": [b"xyzzy plugh"]})
    for context in (b"abr", b"zzy", b"   ", b"qqq"):
        total = np.zeros(2)
        for byte in range(256):
            whole, head = ((np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in (context + bytes([byte]), context))
            total += np.exp2(m.code_lengths(*head)[0] - m.code_lengths(*whole)[0])
        assert np.allclose(total, 1, atol=1e-4)


def slow_code_length(samples, text, lang):
    """Bits of a text by dictionaries of contexts, one language, order 3, method C with exclusion."""
    known = {b for ts in samples.values() for t in ts for b in t}
    counts = collections.defaultdict(collections.Counter)
    symbols = lambda t: [None] * 3 + [b if b in known else None for b in t]
    for t in samples[lang]:
        s = symbols(t)
        for i in range(3, len(s)):
            for k in range(4):
                counts[tuple(s[i - k : i])][s[i]] += 1

    def shares(context):
        if context is None:
            return {**dict.fromkeys(known, 1 / 256), None: 1 - len(known) / 256}
        low, own = shares(context[1:] if context else None), counts.get(context)
        if not own:
            return low
        total, rest = sum(own.values()), sum(p for x, p in low.items() if x not in own)
        escape = len(own) if rest > 1e-12 else 0
        return {x: own[x] / (total + escape) if x in own else escape / (total + escape) * p / rest for x, p in low.items()}

    s = symbols(text)
    return sum(-np.log2(shares(tuple(s[i - 3 : i]))[s[i]]) + (np.log2(256 - len(known)) if s[i] is None else 0) for i in range(3, len(s)))


def test_code_lengths_against_dictionaries():
    samples = {"a": [b"abracadabra abra cad", b"the cat sat"], "b": [b"xyzzy plugh the", "hé cat слово".encode()]}
    m = language_id.train_ppm(samples)
    for text in (b"abra the cat", b"qqq xyzzy", "é hé слов".encode(), b"a", b"the cat sat abracadabra"):
        raw, ends = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
        want = [slow_code_length(samples, text, g) for g in "ab"]
        for chunk in (3, 1 << 18):
            assert np.allclose(m.code_lengths(raw, ends, chunk), [want, want], atol=1e-3)


def test_language_is_found_on_held_out_rows(spark):
    words = {"x": "abc acb bac cab aab".split(), "y": "xyz zyx yxz zzy xxy".split()}
    r = random.Random(0)
    langs = ["x", "y"] * 100
    texts = [" ".join(r.choice(words[g]) for _ in range(20)) for g in langs]
    out = language_id.language_id(frame(spark, texts, langs)).collect()
    assert all(o["lang_pred"] == langs[o["doc_id"]] for o in out)
    assert {o["doc_id"] for o in out if o["held_out"]} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1}
    odd = language_id.language_id(frame(spark, [*texts, "12 34", None], [*langs, "x", "x"])).where("doc_id >= 200").collect()
    assert [(o["lang_pred"], o["score"]) for o in odd] == [("und", 0.0)] * 2


# --- nearest neighbours


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 16))
    x = [(centres[i % 12] + 0.4 * r.standard_normal(16)).tolist() for i in range(900)] + [[1.0] * 16] * 60 + [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 3]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, list int, v int")
    got = collections.defaultdict(list)
    for row in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    m = np.array(x[:960])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 960, 50):
        score = m @ m[q]
        best = [i for i in np.lexsort((np.arange(960), -score.round(12))) if i != q][:5]
        assert len(got[q]) == 5 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hits += len({i for i, _ in got[q]} & set(best))
        total += 5
    assert set(got) == set(range(0, 960, 50)) and hits >= 0.9 * total
    assert [i for i, _ in got[900]] == [901, 902, 903, 904, 905] and [i for i, _ in got[950]] == [900, 901, 902, 903, 904]
    sizes = [1.0, 1e200, 1e-200, 1e307, 5e-300]
    scaled = spark.createDataFrame([(i, [s * v for v in x[i]]) for i in range(100) for s in [sizes[i % 5]]] + [(None, x[0])], "vec_id long, embedding array<double>")
    plain = spark.createDataFrame([(i, x[i]) for i in range(100)], "vec_id long, embedding array<double>")
    one, other = ({(o["query_id"], o["rank"]): (o["vec_id"], round(o["score"], 9)) for o in ann.nearest(f).collect()} for f in (plain, scaled))
    assert one == other and len(one) == 10
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(o["vec_id"], o["rank"]) for o in ann.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(0)).collect() == []


# --- sharding


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path))
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(id % 700 AS int)) AS text", "id div 100 AS arrival", "'c' AS tier", "7 AS _shard", "8 AS _arrival")
    from pyspark.sql import functions as F

    at = F.col("arrival")
    assert store.append(rows.where("arrival < 20"), at) == 1 and store.append(rows.where("arrival >= 20"), at) == 2
    assert store.compact(300_000) == 3
    assert store.read(1).count() == 2000 and store.read(2).count() == store.read(3).count() == 4000
    assert store.read(3).select("doc_id").distinct().count() == 4000 and store.read(3).where("tier = 'c' and _shard = 7 and _arrival = 8").count() == 4000
    merged = [r["n_bytes"] for r in store.manifest(3).collect()]
    assert 1 < len(merged) < 10 and all(n < 600_000 for n in merged)
    with pytest.raises(RuntimeError):
        store.commit(store.manifest(3), 3)


def test_merged_shards_are_merged_again(spark, tmp_path):
    from pyspark.sql import functions as F

    store = sharding.ShardStore(spark, str(tmp_path))
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 1000) AS text")
    for k in range(3):
        store.append(rows.where(f"doc_id div 1000 = {k}"), F.floor(F.col("doc_id") / 50))
        store.compact(1_000_000)  # merges the new arrivals into a shard of one size
    many = store.manifest()
    assert many.count() == 3 and many.where("file_no >= 0").count() == 3
    version = store.compact(4_000_000)  # the three merged shards are alike and become one
    last = store.manifest(version).collect()
    assert len(last) == 1 and (last[0]["n_rows"], last[0]["n_bytes"]) == (3000, 3_000_000)
    assert store.read().select("doc_id").distinct().count() == 3000 and store.compact(4_000_000) == version


def test_of_two_writers_one_commits(spark, tmp_path):
    from pyspark.sql import functions as F

    store, other = sharding.ShardStore(spark, str(tmp_path)), sharding.ShardStore(spark, str(tmp_path))
    rows = spark.range(100).selectExpr("id AS doc_id", "'t' AS text")
    store.append(rows, F.lit(0))
    seen = other.manifest()
    store.append(rows, F.lit(1))
    with pytest.raises(RuntimeError):
        other.commit(seen, 2)
    assert other.read().count() == 200


def test_a_dead_writer_stops_no_other(spark, tmp_path):
    """It dies between its manifest and the commit, with an empty or a finished draft: the next append takes its version."""
    from pyspark.sql import functions as F

    store = sharding.ShardStore(spark, str(tmp_path))
    rows = spark.range(10).selectExpr("id AS doc_id", "'t' AS text")
    store.append(rows, F.lit(0))
    (tmp_path / "drafts" / "dead").write_bytes(b"")
    store.manifest().write.parquet(str(tmp_path / "manifests" / "m-dead"))
    assert store.append(rows, F.lit(1)) == 2 and store.read().count() == 20


# --- personal data


def slow_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group()))


def test_base_spans_against_the_plain_rules():
    r = random.Random(5)
    parts = ["a.b@c.d", "@", "x@y", "@b.c.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+12", " ", "-", ".", "é", "0" * 9, "call", "++1 2 3 4 5 6 7 8 9"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        assert pii.find(text, None)[0] == slow_spans(text), text


def test_boosted_trees_learn_and_add_spans(spark):
    texts = [f"{prose(i, 10)} mail joe{i}@site{i}.example.com or +1 (20{i % 10}) 555-1{i:03d} host 10.0.{i}.7 ok" for i in range(120)]
    model = pii.train(texts)
    base, added = pii.find("write to ann [at] site [dot] com today, call (201) 555-1234 now, version 300.1.2.3", model)
    assert base == [] and [k for _, k, _ in added] == [0, 3]
    out = pii.find_pii(frame(spark, ["a@b.c 1.2.3.4", None]), model).orderBy("doc_id").collect()
    assert (out[0]["n_email"], out[0]["n_ip"], out[0]["spans"]) == (1, 1, "email:0:5,ip:6:13") and out[0]["base_sha256"] == hashlib.sha256(b"email:0:5,ip:6:13").hexdigest()
    assert out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[1]["spans"] == ""
    assert pii.train([]) is None
    token = "so token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and the key: introduction"
    assert [(k, token[a:b]) for a, k, b in pii.find(token, model)[1]] == [(4, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    unseen = [f"{prose(500 + i, 12)} mail ann{i}@host{i}.example.org or +49 (30) 77{i % 10} 44{i:03d} at 10.1.{i}.9 ok" for i in range(60)]
    assert all(p >= 0.95 for p, _, _ in pii.held_out_precision(unseen, model).values())
    quick = "a" * 100_000 + " @ " + "1" * 100_000
    assert pii.find(quick, model) == ([], [])  # linear on runs without a match


# --- packing


def test_ids_equal_the_tokenizer_and_bins_are_gapless(spark):
    odd = ["it's  a 'SA' don't ΣΑΣ İx   a\x1cb", "", "x" * 5000, "ﬁ é é ÀÉ 12,34.5 <|endoftext|> 　hi", "…—“quoted” it'll", "((word)), 'tis 's", LONG]
    path = packing.default_tokenizer()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = [tok.encode(t, add_special_tokens=False).ids for t in odd]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.encode_texts(odd, path)] == ids
    out = packing.best_fit_packing(frame(spark, [*odd, None])).collect()
    for d, i in enumerate([*ids, []]):
        own = sorted((o for o in out if o["doc_id"] == d), key=lambda o: o["piece"])
        whole = np.array([*i, 0], "<u4")
        assert [o["start"] for o in own] == list(range(0, len(whole), 2048)) and sum(o["length"] for o in own) == len(whole)
        assert all(o["ids_crc32"] == zlib.crc32(whole[o["start"] : o["start"] + o["length"]].tobytes()) for o in own)
    check_bins([(o["sequence_id"], o["offset"], o["length"]) for o in out], 2048)


def check_bins(places, capacity):
    bins = collections.defaultdict(list)
    for b, at, n in places:
        bins[b].append((at, n))
    for own in bins.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= capacity
    return len(bins)


def test_plans_are_close_to_the_bound():
    r = random.Random(4)
    for _ in range(200):
        capacity = r.choice([30, 100, 2048])
        sizes = [r.randint(1, capacity) if r.random() < 0.4 else r.randint(1, max(1, capacity // 4)) for _ in range(r.randint(1, 300))]
        places, count = [], collections.Counter()
        for n, first, bins, each, start, offset in packing.plan_packing(dict(collections.Counter(sizes)), capacity):
            assert first == count[n]
            count[n] += bins * each
            places += [(start + b, offset + j * n, n) for b in range(bins) for j in range(each)]
        assert count == collections.Counter(sizes)
        large = sum(3 * n > capacity for n in sizes)
        assert check_bins(places, capacity) <= max(1.25 * sum(sizes) / capacity + 2, large)


def test_hot_length_is_salted(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "if(id % 3 = 0, 700L, id % 50 + 1) AS length", "0L AS ids_crc32")
    out = packing.pack(pieces, 2048, rows_per_group=100).collect()
    total = sum(o["length"] for o in out)
    assert len(out) == 5000 and check_bins([(o["sequence_id"], o["offset"], o["length"]) for o in out], 2048) <= 835  # two of length 700 in a bin


# --- repeated passages


def slow_passages(texts, n=50):
    first, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first.setdefault(b[p : p + n], i) < i:
                gone[p : p + n] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [48, 1])
def test_passages_against_every_window(spark, hot):
    shared, line = prose(7, 60), prose(8, 12)
    texts = [prose(20), None, "short", prose(21, 40) + shared + prose(22, 40), prose(23, 30) + shared, "é" * 40, "é" * 60, "ab" * 80, "ab" * 200, prose(20), prose(20)[:300] + "X" + prose(20)[301:]]
    texts += [prose(30 + i, 15) + line + prose(60 + i, 15) for i in range(20)] + [line * 6, shared[:50], shared[:49]]
    out = suffix_dedup.repeated_passages(frame(spark, texts), bucket_bytes=2000, block_bytes=1500, hot=hot).orderBy("doc_id").collect()
    assert [tuple(o) for o in out] == slow_passages(texts)


def test_suffix_ties_are_resolved_by_samples():
    r = np.random.default_rng(2)
    width = 88
    rows = r.integers(97, 99, (40, width)).astype(np.uint8)
    rows[5], rows[9, 10:70] = rows[1], rows[2, 10:70]
    docs = np.arange(40)
    first, last = suffix_dedup.sort_suffixes(rows, docs, np.full(40, 32), np.full(40, 50), 50)
    assert (first[5], last[5]) == (0, 32) and (first[9], last[9]) == (10, 20) and first[1] == first[2] == -1


# --- fingerprints


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
        r = random.Random(radius)
        for _ in range(3000):
            bits = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not m & bits for m in masks)


def test_components_against_all_pairs(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = [0, 1, 3, 7, 15, 31] + base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(3)]
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    links = simhash.link_within_two(spark.createDataFrame([(p,) for p in signed], "fp long"))
    got = {row["node"]: row["component"] for row in connected_components(links).collect()}
    parent = {p: p for p in signed}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) % (1 << 64)).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert all(got.get(p, p) == root(p) for p in signed)


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    import xxhash

    out = {o["doc_id"]: o for o in simhash.simhash_components(frame(spark, ["The Cat  sat\ton", "a b", None, "", prose(5)])).collect()}
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"the cat sat", b"cat sat on")]
    assert int(out[0]["fingerprint"], 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 2)
    assert out[1]["fingerprint"] == f"{xxhash.xxh64_intdigest(b'a b', 42):016x}"
    assert out[2]["fingerprint"] == "0" * 16 and out[2]["component_id"] == out[3]["component_id"] == 2


def test_near_copies_are_grouped(spark):
    r = random.Random(8)
    originals = [prose(100 + i, 150 + 10 * i) for i in range(20)]
    texts = list(originals)
    for t in originals:
        w = t.split()
        for at in r.sample(range(len(w)), max(1, len(w) // 80)):
            w[at] = "changed"
        texts += [" ".join(w), t]
    out = {o["doc_id"]: o["group_id"] for o in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert all(out[20 + 2 * i] == out[21 + 2 * i] == out[i] == i for i in range(20))


def grouped_by_all_pairs(texts, words=5, similarity=0.8):
    """The groups of near_duplicates by comparing every pair."""
    parts = [t.split() for t in texts]
    sets = [{tuple(p[i : i + words]) for i in range(max(1, len(p) - words + 1))} for p in parts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def replaced(r, words, at, n):
    return words[:at] + ["".join(r.choice("klmnopq") for _ in range(6)) for _ in range(n)] + words[at + n :]


def test_near_copies_inside_one_template_against_all_pairs(spark):
    r = random.Random(31)
    base = prose(300, 200).split()
    # A chain: the last is near the middle one only.
    middle = replaced(r, base, 20, 14)
    texts = [" ".join(base), " ".join(middle), " ".join(replaced(r, middle, 120, 14))]
    for _ in range(60):
        # Families are unlike each other and the template; the two members of one are at 0.80 to 0.85.
        family = base
        for at in r.sample(range(10, 190, 10), 5):
            family = replaced(r, family, at, 1)
        near = family
        for at in r.sample(range(15, 190, 10), 4):
            near = replaced(r, near, at, 1)
        texts += [" ".join(family), " ".join(near)]
    want = grouped_by_all_pairs(texts)
    assert len(set(want)) > 40 and want[0] == want[1] == want[2]
    out = {o["doc_id"]: o["group_id"] for o in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == want


def test_near_copies_with_one_block_appended_or_replaced(spark):
    r = random.Random(32)
    texts = []
    for i in range(40):
        base = prose(400 + i, 400).split()
        share = 0.80 + 0.05 * i / 40
        # Appended: 396 shingles of 396 + n. Replaced: n words cost n + 4 shingles on both sides.
        n = int(396 / share) - 396 if i % 2 else int(396 * (1 - share) / (1 + share)) - 4
        texts += [" ".join(base), " ".join(replaced(r, base, 400 if i % 2 else 150, n))]
    want = grouped_by_all_pairs(texts)
    assert want == [i - i % 2 for i in range(80)]
    out = {o["doc_id"]: o["group_id"] for o in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [out[i] for i in range(80)] == want


def test_long_near_copies_against_all_pairs(spark):
    """Sets beyond the short sketch, their sizes on both sides of a power of two, with unlike ones that share a part."""
    r = random.Random(33)
    base = prose(700, 1100, 3000).split()
    texts = [" ".join(base)]
    for n in (60, 110, 130, 250, 400):
        texts += [" ".join(replaced(r, base, 300, n)), " ".join(base + replaced(r, base, 0, n)[:n])]
    texts += [" ".join(prose(710 + i, 700, 3000).split() + base[:300]) for i in range(3)]
    out = {o["doc_id"]: o["group_id"] for o in simhash.near_duplicates(frame(spark, texts)).collect()}
    want = grouped_by_all_pairs(texts)
    assert [out[i] for i in range(len(texts))] == want and len(set(want)) > 3


# --- lines


def test_lines_one_edit_apart(spark):
    line = "this is a line that is long enough to count, surely it is"
    other = [line[:10] + "X" + line[11:], line[:30] + line[31:], line + "!", "!" + line, line[:5] + "yy" + line[5:]]
    texts = ["short\n" + line, "\n".join(["short", *other]), line + "\n" + line, None, prose(3, 20)]
    out = {o["doc_id"]: o for o in line_dedup.line_dedup(frame(spark, texts), keep=("source",)).collect()}
    assert out[0]["text"] == texts[0] and out[1]["text"] == "short\n" + other[4]
    assert (out[1]["n_near"], out[1]["n_exact"], out[2]["n_exact"], out[2]["text"]) == (4, 0, 2, "")
    assert out[3]["text"] is None and out[3]["n_lines"] == 0 and out[4]["text"] == texts[4] and out[0]["source"] == "s"
    same = {o["doc_id"]: o["n_near"] for o in line_dedup.line_dedup(frame(spark, texts), max_edits=0).collect()}
    assert same[1] == 0


def test_lines_against_all_pairs(spark):
    r = random.Random(9)
    lines = ["".join(r.choice("ab") for _ in range(r.choice([30, 31, 32, 33]))) for _ in range(150)]
    for x in lines[:60]:
        at = r.randrange(len(x))
        lines.append(r.choice([x[:at] + x[at + 1 :] + "", x[:at] + "c" + x[at:], x[:at] + "c" + x[at + 1 :]]) + "")
    lines = [x if len(x) >= 30 else x + "b" * 2 for x in lines]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    out = {o["doc_id"]: o["n_exact"] + o["n_near"] for o in line_dedup.line_dedup(frame(spark, lines)).collect()}
    assert [out[i] for i in range(len(lines))] == [int(any(near(lines[j], lines[i]) for j in range(i))) for i in range(len(lines))]


# --- licenses


def test_license_places_and_labels(spark):
    texts = ["Released under the MIT License. MIT-License", "the Apache\n license, CC-BY 4.0", "this work is licensed under the gnu general public license, version 3.", "permission is hereby granted free of charge to any single person obtaining a copy of this software", None, "mit licenses cc bye"]
    out = {o["doc_id"]: o for o in license_scan.license_scan(frame(spark, texts)).collect()}
    assert (out[0]["n_base"], out[0]["first_word"], out[0]["last_word"], out[0]["base_labels"]) == (2, 3, 5, "mit")
    assert (out[1]["base_labels"], out[1]["n_words"]) == ("apache,cc-by", 7)
    assert out[2]["labels"] == "gpl,gpl-3.0" and out[3]["base_labels"] == "" and out[3]["n_base"] == 0
    assert (out[4]["n_words"], out[4]["labels"], out[4]["first_word"], out[4]["score"]) == (0, "", None, 0.0) and out[5]["labels"] == ""


def test_notices_survive_one_changed_word_and_keep_apart(spark):
    cases = []
    for phrase, (label, keys) in license_scan.NOTICES.items():
        words = phrase.split()
        tied = {j + i for k in map(str.split, keys) for j in range(len(words)) if words[j : j + len(k)] == k for i in range(1, len(k))}
        fixed = {j for k in keys for j, w in enumerate(words) if w in k.split()}
        for j in range(1, len(words) - 1):
            if j not in tied:
                cases.append((label, [*words[:j], "really", *words[j:]]))
            if len(words) > 5 and j not in fixed:
                cases.append((label, [*words[:j], *words[j + 1 :]]))
                cases.append((label, [*words[:j], "really", *words[j + 1 :]]))
    for label, text in [
        ("lgpl", "licensed under the gnu lesser general public license version 3"),
        ("gpl", "gnu general public license"),
        ("gpl,gpl-2.0", "licensed under the gnu general public license version 2"),
        ("", "released under the bsd license"),
        ("", "he studied under the mit professor"),
        ("apache", "licensed under the apache license version 1 1"),
        ("cc-by", "licensed under cc by nc sa 4 0"),
        ("cc-by,cc-by-sa-4.0", "licensed under cc by sa 4 0"),
        ("cc-by", "licensed under cc by 3 0"),
        ("", "the general public license"),
    ]:
        cases.append(("=" + label, text.split()))
    out = {o["doc_id"]: o["labels"] for o in license_scan.license_scan(frame(spark, ["before it " + " ".join(w) + " and after" for _, w in cases])).collect()}
    for i, (label, words) in enumerate(cases):
        assert out[i] == label[1:] if label.startswith("=") else label in out[i].split(","), (label, words, out[i])


# --- decontamination


def slow_tiles(doc, item, least):
    used_doc, used_item, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while j + n < len(item) and i + n < len(doc) and item[j + n] == doc[i + n] and j + n not in used_item and i + n not in used_doc:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return covered
        n, i, j = best
        used_doc.update(range(i, i + n))
        used_item.update(range(j, j + n))
        covered += n


def test_tiling_against_brute_force():
    r = random.Random(10)
    for _ in range(300):
        doc, item = ([r.randint(1, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        assert decontamination.tile(doc, item, 3) == slow_tiles(doc, item, 3)


def test_reordered_passages_are_caught(spark):
    items = [prose(200 + i, 40) for i in range(4)] + ["", None, "two words"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    w = items[1].split()
    texts = [prose(300) + " " + " ".join(w[20:]) + " " + prose(301, 30) + " " + " ".join(w[:20]).upper(), " ".join(items[2].split()[:12]), prose(302), None, "say two, words", items[0]]
    out = {o["doc_id"]: o for o in decontamination.decontaminate(frame(spark, texts), bench, keep=("source",)).collect()}
    assert {i for i, o in out.items() if o["contaminated"]} == {0, 4, 5} and out[0]["item_id"] == 1 and out[0]["coverage"] == 1.0
    assert out[1]["coverage"] == 0 and out[3]["item_id"] is None and out[0]["source"] == "s"
    empty = decontamination.decontaminate(frame(spark, texts), bench.limit(0)).collect()
    assert len(empty) == 6 and not any(o["contaminated"] for o in empty)
    assert decontamination.decontaminate(frame(spark, texts).limit(0), bench).collect() == []


def test_decontamination_against_all_pairs(spark, monkeypatch):
    """Whole results, the Spark join included: a benchmark of several slices, repeated items, texts of one word, a null id."""
    monkeypatch.setattr(decontamination, "ITEMS_PER_SLICE", 3)
    r = random.Random(12)
    pool = [prose(800 + i, 12) for i in range(12)]
    items = [(i, " ".join(r.sample(pool, 3))) for i in range(25)] + [(50, "a1 b1 c1 d1 e1 f1 g1 h1 i1"), (51, pool[1] + " a1 b1 c1 " + pool[1])] + [(3, pool[0]), (3, pool[0]), (40, "lone"), (41, "two words"), (42, ""), (43, None)]
    texts = [" ".join(r.sample(pool, r.randint(1, 6))) + " " + prose(900 + i, 20) for i in range(30)] + ["g1 h1 i1 x d1 e1 f1 y a1 b1 c1", "lone", "a lone. b", "two, WORDS", "", None, LONG + " " + items[5][1], pool[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.decontaminate(frame(spark, [*texts, texts[0]], ids=[*range(len(texts)), None]), bench).collect()
    words = lambda t: decontamination.words((t or "").encode())
    want = {}
    for i, t in enumerate(texts):
        best = {}
        for item, body in items:
            w = words(body)
            if w:
                number = {x: n for n, x in enumerate([*words(t), *w])}
                n = slow_tiles([number[x] for x in words(t)], [number[x] for x in w], min(3, len(w))) if i != len(texts) - 2 else None
                best[item] = max(best.get(item, 0), n / len(w)) if n is not None else 1.0
        best = {k: v for k, v in best.items() if v >= 0.6}
        share = max(best.values(), default=0.0)
        want[i] = (share >= 0.6, min((k for k, v in best.items() if v == share), default=None), share, sum(v >= 0.6 for v in best.values()))
    got = {o["doc_id"]: (o["contaminated"], o["item_id"], o["coverage"], o["n_items"]) for o in out}
    long = len(texts) - 2
    assert got[long][0] and {**got, long: 0, None: 0} == {**want, long: 0, None: 0}
    assert got[None] == got[0] and len(out) == len(texts) + 1
