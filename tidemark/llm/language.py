"""Language identification by segmentation-marginalised unigrams.

The pieces are the letter pieces of a fixed public vocabulary, lower-cased, and every single byte, so that each text
has a segmentation. Each language has a probability for each piece. A pre-token is a space and a run of letters; its
probability in a language is the sum, over all its segmentations into pieces, of the product of their probabilities,
which a forward recursion over a trie of the pieces gives without listing them. A run of more than MAX_WORD bytes is cut
between letters, so only its segmentations with these cuts are summed; the parts but the first have no space. A
text's log-likelihood is the sum over its pre-tokens, each scored once per worker process and kept in a bounded table.

Training is expectation maximisation with the same recursion, forward and backward, over the word counts of a
sample of `max_docs` labelled documents, shared evenly among the languages and taken by seeded hash, but at least one of
each language.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, id_remainder, table

MAX_WORD = 32
MAX_DOCS = 2400
SEED = 7
ROUNDS = 4
#: Least probability of a piece: the product over MAX_WORD bytes and a space stays within a double.
FLOOR = 1e-8
#: Pre-tokens that a worker keeps the scores of.
MAX_TABLE = 300_000
#: Pre-tokens of one length that are scored together.
BLOCK = 20_000
#: Pre-tokens whose evidence the score weighs; the log-likelihood of a longer text is brought down to so many.
EVIDENCE = 16
UNKNOWN = "und"

#: Bytes that aren't letters become spaces; what is beyond ASCII stays.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


#: Before a part of a word that isn't its first; no letter.
CONTINUED = b"\0"


def vocabulary(path: str) -> list[bytes]:
    """The pieces, sorted, of a file of base64 pieces and ranks."""
    pieces = {bytes([b]) for b in range(1, 256)}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0]).lower()
            body = piece[1:] if piece[:1] == b" " else piece
            if body and body.translate(LETTERS) == body and b" " not in body:
                pieces.add(piece)
    return sorted(pieces)


class Trie:
    """keys: state << 8 | byte of every step, sorted; the step at place k leads to state k + 1. piece: of each state, the
    number of the piece that ends there, or -1."""

    def __init__(self, pieces: list[bytes]):
        keys, piece, level = [], [-1], [(0, len(pieces), 0, 0)]
        while level:
            deeper = []
            for first, last, depth, state in level:
                k = first
                while k < last:
                    if len(pieces[k]) == depth:
                        piece[state], k = k, k + 1
                        continue
                    byte, stop = pieces[k][depth], k
                    while stop < last and pieces[stop][depth] == byte:
                        stop += 1
                    keys.append(state << 8 | byte)
                    piece.append(-1)
                    deeper.append((k, stop, depth + 1, len(keys)))
                    k = stop
            level = deeper
        self.keys, self.piece = np.array(keys, np.int64), np.array(piece, np.int32)


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    #: probability of each piece in each language.
    probabilities: np.ndarray


def _bytes_by_length(words: list[bytes]):
    """(places in `words`, matrix of their bytes) for each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        n = int(sizes[at[0]])
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            yield part, np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(len(part), n)


def _arcs(trie: Trie, chars: np.ndarray):
    """(start, stop, rows, pieces) for every stretch, by start: the rows in which [start, stop) is a piece, and which."""
    n, last = chars.shape[1], len(trie.keys) - 1
    columns = chars.T.astype(np.int64)
    for start in range(n):
        rows, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for stop in range(start + 1, n + 1):
            key = state << 8 | columns[stop - 1][rows]
            at = np.minimum(np.searchsorted(trie.keys, key), last)
            alive = trie.keys[at] == key
            rows, state = rows[alive], at[alive] + 1
            if not len(rows):
                break
            piece = trie.piece[state]
            ends = piece >= 0
            if ends.any():
                yield start, stop, rows[ends], piece[ends]


def _forward(arcs, p: np.ndarray, rows: int, n: int) -> np.ndarray:
    """By place and row, in each language: the sum over the segmentations of what is before the place."""
    alpha = np.zeros((n + 1, rows, p.shape[1]))
    alpha[0] = 1
    for start, stop, at, piece in arcs:
        alpha[stop, at] += alpha[start, at] * p[piece]
    return alpha


def log_likelihoods(model: Model, trie: Trie, words: list[bytes]) -> np.ndarray:
    """Of each pre-token in each language."""
    out = np.zeros((len(words), len(model.languages)))
    for at, chars in _bytes_by_length([w[1:] if w[:1] == CONTINUED else b" " + w for w in words]):
        out[at] = np.log(_forward(_arcs(trie, chars), model.probabilities, len(at), chars.shape[1])[-1])
    return out


def _parts(word: bytes):
    """A long word cut between letters."""
    start = 0
    while start < len(word):
        stop = min(len(word), start + MAX_WORD)
        while stop < len(word) and word[stop] & 0xC0 == 0x80:
            stop -= 1
        yield word[start:stop] if not start else CONTINUED + word[start:stop]
        start = stop


def pre_tokens(text: bytes) -> list[bytes]:
    """The words of a text, without their space; what a long one goes on with begins with CONTINUED."""
    words = text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split()
    if words and max(map(len, words)) > MAX_WORD:
        words = [x for w in words for x in (_parts(w) if len(w) > MAX_WORD else (w,))]
    return words


def train(counts: dict[str, Counter], path: str, rounds: int = ROUNDS) -> Model:
    """counts: of each language, how often each pre-token occurs."""
    pieces = vocabulary(path)
    trie, languages = Trie(pieces), sorted(counts)
    words = sorted({w for c in counts.values() for w in c})
    weights = np.array([[counts[lang][w] for lang in languages] for w in words], float).reshape(len(words), len(languages))
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds if words else 0):
        expected = np.zeros_like(p)
        for at, chars in _bytes_by_length([w[1:] if w[:1] == CONTINUED else b" " + w for w in words]):
            n, arcs = chars.shape[1], list(_arcs(trie, chars))
            alpha = _forward(arcs, p, len(at), n)
            beta = np.zeros_like(alpha)
            beta[n] = 1
            share = weights[at] / alpha[n]
            for start, stop, rows, piece in reversed(arcs):
                onward = p[piece] * beta[stop, rows]
                beta[start, rows] += onward
                use = alpha[start, rows] * onward * share[rows]
                for k in range(len(languages)):
                    expected[:, k] += np.bincount(piece, use[:, k], len(expected))
        p = np.maximum(expected / np.maximum(expected.sum(axis=0), 1), FLOOR)
    return Model(languages, pieces, p)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.trie = model, Trie(model.pieces)
        self.place: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def learn(self, words: set[bytes]) -> None:
        """Scores the new ones of the pre-tokens of a few texts together; if the table gets too long, it begins again with them."""
        new = words - self.place.keys()
        if len(self.place) + len(new) > MAX_TABLE:
            self.place, self.scores, new = {}, self.scores[:0], words
        if new:
            new = list(new)
            self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, log_likelihoods(self.model, self.trie, new)))

    def predict_all(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        words = [pre_tokens(t) if t else [] for t in texts]
        self.learn(set().union(*words))
        return [self._judged(t, w) for t, w in zip(texts, words, strict=True)]

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def _judged(self, text: bytes | None, words: list[bytes]) -> tuple[str, float]:
        if not text or not self.model.languages or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return UNKNOWN, 0.0
        total = self.scores[list(map(self.place.__getitem__, words))].sum(axis=0)
        weighed = total * min(1.0, EVIDENCE / max(len(words), 1))
        share = np.exp(weighed - weighed.max())
        best = int(np.argmax(share))
        return self.model.languages[best], float(share[best] / share.sum())


_scorers: dict[str, Scorer] = {}


def _predicting(key: str, model):
    """Replaces the last column, the text's bytes, by the prediction."""

    def run(batches):
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(model.value)
        scorer = _scorers[key]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i in range(0, len(texts), 256):
                part = batch.slice(i, 256)
                found = scorer.predict_all([x.as_py() for x in texts[i : i + 256]])
                lang, score = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lang, score], names=[*batch.schema.names[:-1], batch.schema.names[-1] + "_lang", batch.schema.names[-1] + "_score"])

    return run


def _counting(batches):
    """Word counts of a partition's texts by language, whole texts."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.setdefault(lang, Counter()).update(pre_tokens(text.as_py()))
    for lang, c in counts.items():
        words = list(c)
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.binary()), pa.array([c[w] for w in some], pa.int64())], ["lang", "word", "n"])


def learn(docs: DataFrame, path: str, max_docs: int = MAX_DOCS) -> Model:
    """A model from the rows of `docs` (doc_id, text, lang) that have a text and a lang and aren't held out."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", 5) != 0))
    # A share of each language's documents, by a hash that is even over [0, 1), and the first by that hash in any case.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    # A row for each language; the model, too, has a column for each.
    sizes = {r["lang"]: (r["n"], r["first"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first")).toLocalIterator()}
    if not sizes:
        return train({}, path)
    each = max_docs / len(sizes)
    share = F.map_from_arrays(F.array(*map(F.lit, sizes)), F.array(*[F.lit(max(first, min(1.0, each / n))) for n, first in sizes.values()]))
    sample = usable.filter(place <= F.element_at(share, F.col("lang"))).select("lang", F.col("text").cast("binary").alias("text"))
    totals = sample.mapInArrow(_counting, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for row in totals.toLocalIterator():
        counts[row["lang"]][bytes(row["word"])] = row["n"]
    return train(counts, path)


def identify(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """`docs` with all columns and two more, and the names of these: language and score."""
    name = fresh(docs, "found")
    while {f"{name}_lang", f"{name}_score"} & {c.lower() for c in docs.columns}:
        name = f"_{name}"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(name, F.col("text").cast("binary")).mapInArrow(_predicting(uuid.uuid4().hex, sent), f"{kinds}, `{name}_lang` string, `{name}_score` double")
    return out, f"{name}_lang", f"{name}_score"


def language_id(docs: DataFrame, path: str, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs` (doc_id, text, lang).

    Learns from rows whose crc32(doc_id) mod 5 isn't 0; a null id is neither learned from nor held out. Predictions
    see the text alone. A null text, or one without a letter, is `und` with score 0; so is everything if there is
    nothing to learn from. Of languages that are equally likely the first by name is taken. The score is the posterior, with equal priors, of the text's mean pre-token taken
    EVIDENCE times (as often as there are, if fewer). Repeated rows each give a row; an empty table gives none; other
    columns are ignored.
    """
    found, lang, score = identify(docs.select("doc_id", "text"), learn(docs, path, max_docs))
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def keep_known(docs: DataFrame, path: str, least: float = 0.5, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of `docs`, all columns, whose language is found with a score of `least` or more."""
    found, lang, score = identify(docs, learn(docs, path, max_docs))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return language_id(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
