"""Token counts by pre-token: the pieces of each distinct pre-token of the corpus are counted once, joined to the
frequencies of pre-tokens in each document, and summed. No ids are made for a text.

A byte-level BPE never merges across pre-tokens, so the sum is exact. The texts are read twice. The first time gives
all distinct pre-tokens with their numbers, partly added up before the shuffle; of these the tokenizer's library
counts the pieces. The second time gives each document's frequencies. The join has two sides: the most frequent pre-tokens, FREQUENT
at most and of LONG characters at most, go to the executors as a table, so that their frequencies are summed where the text is; only
rows of (document, rarer pre-token) are shuffled. None of these is a hot key, for all hot ones are in the table. A
pre-token of more than LONG characters is counted where it stands, which is less work than sending it.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

# What the byte-level pre-tokenizer's pattern, as the vocabulary's publisher gives it, takes for letters
# and for numbers among the characters of COMMON.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼½¾"
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Texts of these characters are split by PATTERN; for others the library's own pre-tokenizer is asked.
COMMON = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-ſ‐-‧‰-⁞€]*")
FREQUENT = 300_000
#: Longer pre-tokens are counted in place.
LONG = 64
#: Distinct pre-tokens that a task holds before it passes their numbers on.
HELD = 400_000
LIMIT = 512


class Splitter:
    """Pre-tokens and their pieces as the library has them, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.by_special = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None

    def _segment(self, text: str) -> list[str]:
        if COMMON.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str | None) -> tuple[int, list[str]]:
        """How many special strings a text has, each of which is by default one token and splits the text, and its
        pre-tokens."""
        if not text:
            return 0, []
        if self.by_special is None or not any(x in text for x in self.special):
            return 0, self._segment(text)
        parts = self.by_special.split(text)
        return len(parts) - 1, [x for part in parts if part for x in self._segment(part)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch(pre_tokens, add_special_tokens=False)]


_splitters: dict[str, Splitter] = {}


def _splitter(path: str) -> Splitter:
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def _numbers(path: str):
    """Of rows (text): (pre, n), the pre-tokens of at most LONG characters and their numbers."""

    def passed(numbers: Counter):
        pre = [x for x in numbers if len(x) <= LONG]
        for i in range(0, len(pre), 50_000):
            some = pre[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([numbers[x] for x in some], pa.int64())], ["pre", "n"])

    def run(batches):
        split, numbers = _splitter(path).split, Counter()
        for batch in batches:
            for text in batch.column(0):
                numbers.update(split(text.as_py())[1])
                if len(numbers) > HELD:
                    yield from passed(numbers)
                    numbers.clear()
        yield from passed(numbers)

    return run


def _pieces(path: str):
    """Rows (pre, n) with the number of pieces."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                part = batch.slice(i, 10_000)
                found = _splitter(path).pieces(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int32())], ["pre", "n", "pieces"])

    return run


REST = pa.list_(pa.struct([("pre", pa.string()), ("n", pa.int32())]))


def _frequencies(path: str, frequent):
    """Rows (doc_id, n_bytes, text) with the text replaced by the tokens that are known where it stands and the frequencies
    of its other pre-tokens."""

    def run(batches):
        splitter, known = _splitter(path), frequent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sums, names, numbers, sizes = [], [], [], []
                for text in part.column(2):
                    n, pre_tokens = splitter.split(text.as_py())
                    found = list(map(known.get, pre_tokens))
                    rest: Counter = Counter()
                    if None in found:
                        rest.update(x for x, k in zip(pre_tokens, found, strict=True) if k is None)
                        found = [k for k in found if k is not None]
                        if long := [x for x in rest if len(x) > LONG]:
                            n += sum(rest.pop(x) * k for x, k in zip(long, splitter.pieces(long), strict=True))
                    sums.append(n + sum(found))
                    names += rest.keys()
                    numbers += rest.values()
                    sizes.append(len(rest))
                rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32())], ["pre", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.array([0, *accumulate(sizes)], np.int32)), rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sums, pa.int64()), lists], ["doc_id", "n_bytes", "known", "rest"])

    return run


def frequent_pieces(pieces: DataFrame, most: int) -> dict[str, int]:
    """The pieces of the most frequent pre-tokens, `most` at most: those of the upper steps of n, 16 for each doubling."""
    step = F.floor(F.log2("n") * 16)
    least, total = None, 0
    for row in sorted(pieces.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):  # a row for each step, a thousand at most
        total += row["n"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return {}
    return {r["pre"]: r["pieces"] for r in pieces.filter(step >= least).select("pre", "pieces").toLocalIterator()}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row of `docs` (doc_id, text).

    `path` is a byte-level BPE file of the tokenizers library that every executor can open under that name. Null and
    empty texts have no bytes and no tokens; repeated rows and null ids each give a row; an empty table gives none;
    further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = docs.select("text").mapInArrow(_numbers(path), "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    pieces = materialise(numbers.mapInArrow(_pieces(path), "pre string, n long, pieces int"))
    sent = docs.sparkSession.sparkContext.broadcast(frequent_pieces(pieces, frequent))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    found = rows.mapInArrow(_frequencies(path, sent), f"doc_id {kind}, n_bytes long, known long, rest array<struct<pre:string,n:int>>")
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()))
    rare = found.select("row", F.inline("rest")).join(pieces.select("pre", "pieces"), "pre")
    more = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return found.drop("rest").join(more, "row", "left").select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
