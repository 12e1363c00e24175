"""Personal data by gradient boosting over candidate spans.

High-recall generators propose overlapping spans of five kinds, secrets among them. The base rules settle spans that
match a strict format; the other candidates are described by format and context features and scored
by boosted trees. The trees are trained on candidates of a bounded sample of documents, labelled by
the format checks, and on rewritten copies of them in forms the base rules miss. For each kind the
threshold is the lowest that keeps the wanted precision on a held-out quarter of the training rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first four have base rules; secrets are found by the method alone.
KINDS = ("email", "ip", "card", "phone", "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN_TAIL = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The base rules; possessive and anchored at the start of a digit run, so that no text takes more than linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: What the base rules miss: written-out addresses, numbers without the plus sign.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[\[(<] ?at ?[\])>] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(<] ?dot ?[\])>] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")
_ABROAD = re.compile(r"(?<![0-9+.])00[1-9][0-9](?:[\x20().-]?[0-9]){6,13}(?![0-9])")
_SECRET = re.compile(r"\b(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|key|auth|bearer)\b[\"']?\x20?[:=]?\x20?[\"']?([A-Za-z0-9_/+=-]{8,256})", re.I)
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}(?![0-9A-Za-z])", re.I)
_CONTEXT = [
    re.compile(r"token|secret|passw|pwd|api.?key|auth|bearer", re.I),
    re.compile(r"mail|contact|write", re.I),
    re.compile(r"call|phone|tel|mobile|fax|cell", re.I),
    re.compile(r"card|visa|master|pay|credit|iban", re.I),
    re.compile(r"\bip\b|host|server|addr|ping|login", re.I),
    re.compile(r"version|release|chapter|section|page|isbn|invoice|order|part|no\.", re.I),
]
_WINDOW = 24


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain, found from each @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN_TAIL.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, settled by a base rule) of every proposed span."""
    found: list[tuple[int, int, int, bool]] = []
    if "@" in text:
        found += [(0, a, b, True) for a, b in base_emails(text)]
    if re.search(r"[\[(<] ?at ?[\])>]| at \S{1,63}(?: ?[\[(<] ?dot| dot )", text, re.I):
        found += [(0, m.start(), m.end(), False) for m in _SPELT.finditer(text) if re.search(r"[\[(<]| dot ", m.group(), re.I)]
    secrets = {(m.start(1), m.end(1)) for m in _SECRET.finditer(text)}
    secrets |= {(m.start(), m.end()) for m in _HEX.finditer(text)}
    found += [(4, a, b, False) for a, b in sorted(secrets)]
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m.group().split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 9 <= len(d) <= 24:
            found.append((2, m.start(), m.end(), 12 <= len(d) <= 19 and luhn(d)))
    if "+" in text:
        found += [(3, m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15) for m in _PHONE.finditer(text)]
    found += [(3, m.start(), m.end(), False) for p in (_LOCAL_PHONE, _ABROAD) for m in p.finditer(text)]
    return found


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    d = _digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    before, after = text[max(0, start - _WINDOW) : start], text[end : end + _WINDOW]
    parts = [int(p[:9]) for p in re.findall("[0-9]+", span)]
    counts = np.unique(np.frombuffer(span.encode()[:256] or b" ", np.uint8), return_counts=True)[1]
    share = counts / counts.sum()
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        -float((share * np.log2(share)).sum()), len(d) / max(1, len(span)), sum(map(str.isupper, span)) / max(1, len(span)), float(bool(re.fullmatch("[0-9a-fA-F]+", span))), float(span[:2] == "00"),
        len(span), len(d), len(groups), max(groups, default=0), min(groups, default=0),
        float(span[:1] == "+"), span.count("("), span.count("."), span.count("-"), span.count(" "), span.count("@"),
        float(bool(re.search(r"[\[(<] ?at", span, re.I))), float(bool(re.search(r"dot", span, re.I))),
        float(len(d) > 1 and luhn(d)), float(max(parts, default=0) <= 255), float(len(set(d)) <= 2),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "-./_"), float(after[:1] in "-/_"),
        *[float(bool(p.search(before))) for p in _CONTEXT],
    ]


@dataclass
class BoostedTrees:
    """Logistic gradient boosting with small trees: each is (feature, cut, left, right) lists and leaf values."""

    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    bias: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> BoostedTrees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
        score = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple[int, float, int, int, float]] = []
            self._grow(tree, x, y - p, p * (1 - p), np.arange(len(y)), cuts, depth, rate, least)
            self.trees.append(tree)
            score += self._one(tree, x)
        return self

    def _grow(self, tree, x, g, h, rows, cuts, depth, rate, least) -> int:
        here = len(tree)
        total, weight = g[rows].sum(), h[rows].sum() + 1.0
        tree.append((-1, 0.0, 0, 0, rate * float(total / weight)))
        best = (1e-6, -1, 0.0)
        for f in range(x.shape[1]) if depth else ():
            for cut in cuts[f]:
                left = x[rows, f] <= cut
                if least <= left.sum() <= len(rows) - least:
                    gl, hl = g[rows][left].sum(), h[rows][left].sum() + 1.0
                    gain = gl**2 / hl + (total - gl) ** 2 / (weight - hl + 2.0) - total**2 / weight
                    if gain > best[0]:
                        best = (gain, f, float(cut))
        if best[1] >= 0:
            left = x[rows, best[1]] <= best[2]
            a = self._grow(tree, x, g, h, rows[left], cuts, depth - 1, rate, least)
            b = self._grow(tree, x, g, h, rows[~left], cuts, depth - 1, rate, least)
            tree[here] = (best[1], best[2], a, b, 0.0)
        return here

    @staticmethod
    def _one(tree, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, cut, a, b, value = tree[node]
            if f < 0:
                out[rows] = value
            else:
                left = x[rows, f] <= cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((self._one(t, x) for t in self.trees), np.zeros(len(x))))))


@dataclass
class PiiModel:
    trees: BoostedTrees
    thresholds: tuple[float, ...]


def _rewritten(text: str, kind: int, start: int, end: int, rng: np.random.Generator) -> tuple[str, int, int, bool] | None:
    """A settled span in a form that the base rules miss, or a look-alike that holds no personal data."""
    span = text[start:end]
    choice = rng.integers(3)
    if kind == 0:
        mark = ("[at]", "(at)", " at ")[choice]
        new = span.replace("@", mark if choice == 2 else f" {mark} ").replace(".", (" dot ", " [dot] ", " (dot) ")[choice])
        return text[:start] + new + text[end:], start, start + len(new), True
    if kind == 1:  # a version number
        parts = span.split(".")
        parts[choice] = str(rng.integers(256, 1000))
        new = ".".join(parts)
        return text[:start] + new + text[end:], start, start + len(new), False
    if kind == 2:  # a number whose check digit is wrong
        new = span[:-1] + str((int(span[-1]) + int(rng.integers(1, 10))) % 10)
        return text[:start] + new + text[end:], start, end, False
    if kind == 3:
        d = _digits(span)[-10:]
        if len(d) < 10:
            return None
        if choice == 2:  # a date and a running number
            new = f"{d[:4]}-{d[4:7]}-{d[7:]}{rng.integers(10)}"
            head = text[:start] + "invoice no. "
            return head + new + text[end:], len(head), len(head) + len(new), False
        new = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}")[choice]
        head = text[:start] + ("call ", "phone: ", "tel ")[rng.integers(3)]
        return head + new + text[end:], len(head), len(head) + len(new), True
    return None


def _planted(text: str, rng: np.random.Generator) -> list[tuple[str, int, int, bool]]:
    """Forms that no base rule knows put into a text: a secret, a plain word in its place, a number abroad, a running number."""
    letters = np.array(list("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    size = int(rng.integers(16, 64))
    secret = "".join(letters[rng.integers(0, (16, 36, 62)[rng.integers(3)], size)])
    words = re.findall("[A-Za-z]{8,}", text) or ["documents"]
    abroad = "0049" + "".join(map(str, rng.integers(0, 10, 9)))
    cut = text.find(" ", len(text) // 2) + 1
    out = []
    for lead, value, good in (
        (("token = ", "api_key: ", "password=")[rng.integers(3)], secret, True), (("token ", "key: ", "secret ")[rng.integers(3)], words[rng.integers(len(words))], False),
        (("call ", "tel ", "fax ")[rng.integers(3)], abroad, True), (("invoice ", "part no. ", "order ")[rng.integers(3)], abroad, False),
    ):
        head = text[:cut] + lead
        out.append((head + value + " " + text[cut:], len(head), len(head) + len(value), good))
    return out


def labelled(texts: list[str], most_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, document) of at most ``most_rows`` candidates of ``texts`` and of rewritten copies of them."""
    rng = np.random.default_rng(seed)
    xs, ys, docs = [], [], []

    def add(text, kind, a, b, label, doc):
        xs.append(features(text, kind, a, b))
        ys.append(float(label))
        docs.append(doc)

    for doc, text in enumerate(texts):
        if len(xs) >= most_rows:
            break
        for kind, a, b, settled in candidates(text):
            if kind < 4 and (settled or kind != 3 or text[a] == "+"):
                add(text, kind, a, b, settled, doc)
            if settled and (new := _rewritten(text, kind, a, b, rng)):
                add(new[0], kind, new[1], new[2], new[3], doc)
        if doc % 2 == 0:
            for (new, a, b, good), kind in zip(_planted(text, rng), (4, 4, 3, 3), strict=True):
                add(new, kind, a, b, good, doc)
    return np.array(xs, float), np.array(ys), np.array(docs)


def train(texts: list[str], precision: float = 0.98, most_rows: int = 8000, seed: int = 7) -> PiiModel | None:
    """Trees and thresholds from at most ``most_rows`` candidates of ``texts``; None if there are none.

    The thresholds are calibrated on every fourth document, which the trees have not seen.
    """
    x, y, docs = labelled(texts, most_rows, seed)
    if not len(x):
        return None
    check = docs % 4 == 3
    if not (~check).any() or len(x) < 8:
        check[:] = False
    trees = BoostedTrees().fit(x[~check], y[~check])
    p, kinds = trees.probability(x), x[:, : len(KINDS)].argmax(1)
    thresholds = []
    for k in range(len(KINDS)):
        own = (kinds == k) & (check if check.any() else True)
        limit = 0.5
        for t in sorted(set(p[own].round(3)) | {0.5}):
            if t >= 0.5 and (chosen := own & (p >= t)).any():
                limit = t
                if y[chosen].mean() >= precision:
                    break
        thresholds.append(max(0.5, float(limit)))
    return PiiModel(trees, tuple(thresholds))


def held_out_precision(texts: list[str], model: PiiModel, most_rows: int = 8000, seed: int = 8) -> dict[str, tuple[float, float, int]]:
    """(precision, recall, candidates) of each kind over labelled candidates of ``texts`` that the model was not trained on."""
    x, y, _ = labelled(texts, most_rows, seed)
    p, kinds = model.trees.probability(x), x[:, : len(KINDS)].argmax(1)
    chosen = p >= np.array(model.thresholds)[kinds]
    out = {}
    for k, name in enumerate(KINDS):
        own = kinds == k
        out[name] = (float(y[own & chosen].mean()) if (own & chosen).any() else 1.0, float(chosen[own & (y > 0)].mean()) if (own & (y > 0)).any() else 1.0, int(own.sum()))
    return out


def training_texts(docs: DataFrame, most: int = 3000, max_bytes: int = 16384) -> list[str]:
    """A bounded sample: at most ``most`` texts of at most ``max_bytes`` bytes that hold a digit or an @, by a hash of the text."""
    rows = docs.select("text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes) & F.col("text").rlike("[0-9@]"))
    n = rows.count()
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    near = rows.withColumn("place", place).where(F.col("place") < min(1.0, 2.0 * most / max(n, 1)) * float(1 << 30))
    return [r[0] for r in near.orderBy("place", "text").limit(most).select("text").collect()]


def find(text: str, model: PiiModel | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, each (start, kind, end) in order; added ones overlap no other span, the surest are taken first."""
    found = candidates(text)
    base = sorted((a, k, b) for k, a, b, settled in found if settled)
    rest = [(k, a, b) for k, a, b, settled in found if not settled]
    added: list[tuple[int, int, int]] = []
    if rest and model:
        p = model.trees.probability(np.array([features(text, *c) for c in rest], float))
        # Base spans of two kinds may overlap; what they cover together is a list of gaps and spans in order.
        taken: list[tuple[int, int]] = []
        for a, _, b in base:
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(taken[-1][1], b))
            else:
                taken.append((a, b))
        for score, (k, a, b) in sorted(zip(-p, rest, strict=True)):
            at = bisect_left(taken, (b, 0))  # spans before this one start before b
            if -score >= model.thresholds[k] and not (at and taken[at - 1][1] > a):
                added.append((a, k, b))
                taken.insert(at, (a, b))
    return base, sorted(added)


def find_pii(docs: DataFrame, model: PiiModel | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base counts and digest, and all spans.

    A null text is empty. Offsets are code points, ends exclusive. Without a model only the base
    rules act. Rows are judged one by one: repeated rows give equal results, a null id changes nothing,
    an empty table gives no rows, texts of any length are scanned whole, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find(text or "", shared.value)
                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((*counts, hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + added)), len(added), len(base) + len(added)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def detect_pii(docs: DataFrame) -> DataFrame:
    """Train on a bounded sample of ``docs`` and scan every text of it."""
    return find_pii(docs, train(training_texts(docs)))
