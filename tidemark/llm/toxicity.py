"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of words of two lexicons, how near their words stand to the second person, capitals,
punctuation and the rate of obfuscated spellings. One lexicon is fixed, the other is learned: words, and beginnings
of words, that occur in toxic documents far more often than in others. Training rows see the lexicon that the other
half of the sample gave, so the trees learn from hits as they will be on unseen texts. The calibration is fitted on
predictions for the half that a first model hasn't seen.

The sample has at most `max_toxic` and `max_other` labelled rows, taken by seeded hash, with whole texts; each counts
as many rows as it stands for. Training runs on the driver over one row of features each.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_remainder, table

MAX_TOXIC = 1500
MAX_OTHER = 3000
MAX_TERMS = 2000
SEED = 11
CUTOFF = 0.7
#: Lengths of the beginnings of words that the learned lexicon may hold.
STEMS = (4, 5, 6)
#: Words between a hit and the second person that count as near.
NEAR = 5
MAX_TABLE = 300_000

# Fixed values.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown dumb fool imbecile filthy vermin filth cretin idiota imbécil estúpido basura asco inútil idiote imbécile stupide ordure débile minable abruti dumm blöd abschaum dreck versager widerlich trottel"
SECOND_PERSON = "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros"
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": ""}

FEATURES = (
    "log_words", "insults", "insults_distinct", "learned", "learned_weight", "learned_most", "learned_distinct", "near_second_person",
    "second_person", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_hits", "stretched",
)

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_ALPHA = _UPPER + bytes(range(97, 123))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SHOUTED = re.compile(rb"(?<![A-Za-z])[A-Z]{2,}+(?![a-z])")
_HIDDEN = re.compile(rb"(?<![a-z0-9])[a-z]++(?:[0134578@$!*]++[a-z]++)++")
_LETTER_BY_LETTER = re.compile(rb"(?<![a-z])[a-z](?:[ ._-][a-z]){3,}(?![a-z])")
_STRETCHED = re.compile(rb"([a-z])\1\1")
_INSULTS = frozenset(INSULTS.encode().split())
_SECOND = frozenset(SECOND_PERSON.encode().split())
_LEET = bytes.maketrans("".join(k for k, v in LEET.items() if v).encode(), "".join(v for v in LEET.values() if v).encode())
_DROPPED = "".join(k for k, v in LEET.items() if not v).encode()


def lowered(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode()


def terms(text: bytes | None) -> set[bytes]:
    """The distinct words of a text, and their beginnings with a star."""
    words = set(lowered(text or b"").translate(_LETTERS).split())
    return words | {w[:n] + b"*" for w in words for n in STEMS if len(w) > n}


class Features:
    """The features of a text under one learned lexicon."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon
        #: word: 0, its weight if it is in the learned lexicon, less 100 in the fixed one, -1 for the second person
        self.known: dict[bytes, float] = {}

    def _code(self, word: bytes) -> float:
        if word in _SECOND:
            return -1.0
        get = self.lexicon.get
        weight = max([get(word, 0.0), *(get(word[:n] + b"*", 0.0) for n in STEMS if len(word) > n)])
        return weight + 100 if word in _INSULTS else weight

    def _codes(self, words: list[bytes]) -> np.ndarray:
        codes = list(map(self.known.get, words))
        if None in codes:
            if len(self.known) > MAX_TABLE:
                self.known.clear()
            for w in {w for w, c in zip(words, codes, strict=True) if c is None}:
                self.known[w] = self._code(w)
            codes = [self._code(w) if c is None else c for w, c in zip(words, codes, strict=True)]
        return np.array(codes)

    def __call__(self, text: bytes | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        low = lowered(text)
        words = low.translate(_LETTERS).split()
        n, size = max(1, len(words)), max(1, len(text))
        codes = self._codes(words) if words else np.zeros(0)
        second = np.flatnonzero(codes == -1)
        hits = np.flatnonzero(codes > 0)
        weights = codes[hits]
        fixed, weights = weights >= 100, weights % 100
        near = 0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            before = np.where(at > 0, hits - second[np.maximum(at - 1, 0)], n)
            after = np.where(at < len(second), second[np.minimum(at, len(second) - 1)] - hits, n)
            near = int((np.minimum(before, after) <= NEAR).sum())
        hidden = _HIDDEN.findall(low) + [re.sub(rb"[ ._-]", b"", x) for x in _LETTER_BY_LETTER.findall(low)]
        plain = [x.translate(_LEET, _DROPPED) for x in hidden]
        letters = size - len(text.translate(None, _ALPHA)) if text else 0
        return [
            float(np.log1p(len(words))),
            100 * float(fixed.sum()) / n,
            float(len({words[i] for i in hits[fixed]})),
            100 * float((weights > 0).sum()) / n,
            100 * float(weights.sum()) / n,
            float(weights.max()) if len(weights) else 0.0,
            float(len({words[i] for i in hits[weights > 0]})),
            100 * near / n,
            100 * len(second) / n,
            (size - len(text.translate(None, _UPPER))) / max(1, letters),
            len(_SHOUTED.findall(text)) / n,
            text.count(b"!") / n,
            text.count(b"?") / n,
            (size - len(text.translate(None, _PUNCTUATION))) / size,
            100 * len(hidden) / n,
            100 * sum(self._code(x) > 0 for x in plain) / n,
            100 * len(_STRETCHED.findall(low)) / n,
        ]


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: each inner node's feature and threshold, each leaf's value."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < len(feature) if len(x) else False:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, penalty: float = 1.0, bins: int = 32) -> Trees:
    """Logistic loss, second-order gains over quantile bins; full trees of the given depth."""
    rate_of_one = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    inner, margin = 2**depth - 1, np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    w = w / w.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            if len(at) > 1:
                best = 1e-6
                total_g, total_h = g[at].sum(), h[at].sum()
                for f, e in enumerate(edges):
                    if len(e):
                        gl = np.cumsum(np.bincount(binned[at, f], g[at], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[at, f], h[at], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + penalty) + (total_g - gl) ** 2 / (total_h - hl + penalty) - total_g**2 / (total_h + penalty)
                        i = int(np.argmax(gain))
                        if gain[i] > best:
                            best, feature[k], threshold[k] = gain[i], f, e[i]
            node[at] = 2 * k + 1 + (x[at, feature[k]] > threshold[k])
        leaf = node - inner
        values = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        margin += values[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(values)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the middle margin and the rate of each pool, for interpolation."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # weight, weighted label, weighted margin
    for m, label, weight in zip(margin[order], y[order], w[order], strict=True):
        pools.append([weight, weight * label, weight * m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees | None
    margins: np.ndarray
    rates: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), float(self.rates[0]))
        margin = self.trees.margin(x)
        # A thousandth of the uncalibrated score orders texts of one pool.
        return 0.999 * np.interp(margin, self.margins, self.rates) + 0.001 / (1 + np.exp(-margin))


def weights_of(counts, docs: tuple[float, float]) -> dict[bytes, float]:
    """counts: (term, toxic documents, others); docs: how many documents of either kind there are."""
    scored = []
    for term, toxic, other in counts:
        weight = float(np.log((toxic + 0.5) / (docs[0] + 1)) - np.log((other + 0.5) / (docs[1] + 1)))
        if toxic >= max(3, 0.002 * docs[0]) and weight >= 2:
            scored.append((weight * toxic, weight, term))
    return {term: weight for _, weight, term in sorted(scored, reverse=True)[:MAX_TERMS]}


def _terms(batches):
    """Of rows (half, toxic, text): in how many documents of each half and kind each term is."""
    counts = {(h, t): Counter() for h in (0, 1) for t in (0, 1)}
    for batch in batches:
        for half, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            counts[half, toxic].update(terms(text.as_py()))
    every = list(set().union(*counts.values()))
    for i in range(0, len(every), 50_000):
        some = every[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())] + [pa.array([counts[k][x] for x in some], pa.int64()) for k in ((0, 1), (0, 0), (1, 1), (1, 0))], ["term", "t0", "n0", "t1", "n1"])


def _trained_features(lexicons):
    def run(batches):
        of = [Features(x) for x in lexicons.value]
        for batch in batches:
            half = batch.column(0).to_pylist()
            found = [of[1 - h](t.as_py()) for h, t in zip(half, batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["half", "toxic", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    spark = docs.sparkSession
    # A document labelled twice counts as toxic if it is once.
    known = labels.filter(F.col("toxic").isNotNull() & (id_remainder("doc_id", 3) != 1)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    empty = Model({}, None, np.zeros(1), np.array([1.0 if sizes.get(1) and not sizes.get(0) else 0.0]))
    if not sizes.get(0) or not sizes.get(1):
        return empty
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(max_other))
    rows = picked.select("doc_id", "toxic", F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), F.lit(2)).cast("int").alias("half")).collect()
    # At most max_toxic + max_other rows of three numbers.
    picked = F.broadcast(spark.createDataFrame(rows, picked.withColumn("half", F.lit(0)).schema))
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(picked, "doc_id").select("half", "toxic", "text")
    counted = sample.mapInArrow(_terms, "term binary, t0 long, n0 long, t1 long, n1 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t0", "n0", "t1", "n1")])
    counted = [(bytes(r["term"]), r["t0"], r["n0"], r["t1"], r["n1"]) for r in counted.filter("t0 + t1 >= 3 and t0 + t1 > n0 + n1").toLocalIterator()]
    n = Counter((r["half"], r["toxic"]) for r in rows)
    lexicons = [weights_of(((c[0], c[1 + 2 * h], c[2 + 2 * h]) for c in counted), (n[h, 1], n[h, 0])) for h in (0, 1)]
    found = sample.mapInArrow(_trained_features(spark.sparkContext.broadcast(lexicons)), "half int, toxic int, x array<double>").collect()
    if not found:
        return empty
    half, y, x = (np.array([r[k] for r in found], float) for k in ("half", "toxic", "x"))
    # In one order, whatever order the rows came in.
    order = np.lexsort((*x.T, y, half))
    half, y, x = half[order], y[order], x[order]
    w = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    unseen = np.zeros(len(y))
    for h in (0, 1):
        other = half != h
        if other.any() and (half == h).any():
            unseen[half == h] = boost(x[other], y[other], w[other]).margin(x[half == h])
    margins, rates = isotonic(unseen, y, w)
    lexicon = weights_of(((c[0], c[1] + c[3], c[2] + c[4]) for c in counted), (n[0, 1] + n[1, 1], n[0, 0] + n[1, 0]))
    return Model(lexicon, boost(x, y, w), margins, rates)


_features: dict[str, Features] = {}


def _scoring(key: str, model):
    def run(batches):
        if key not in _features:
            _features.clear()
            _features[key] = Features(model.value.lexicon)
        for batch in batches:
            x = np.array([_features[key](t.as_py()) for t in batch.column(1)], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x), pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text); `labels` has doc_id and toxic.

    Learns from labels of rows whose crc32(doc_id) mod 3 isn't 1. Scores see the text alone; null and empty texts get
    the score of a text without any feature. A null id is neither learned from nor held out. Without labels of both
    kinds every score is the one label's value, or 0. Repeated rows each give a row; an empty table gives none; other
    columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_scoring(uuid.uuid4().hex, sent), f"doc_id {kind}, score double")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
