"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of each text.

A-Z are lower-cased and words are runs of 0-9, a-z and everything beyond ASCII. Windows are the runs of `window`
consecutive words of an item, or all its words if it has fewer. The automaton holds each distinct window between
spaces; a text is scanned once, with its words between single spaces, and every occurrence is mapped back to words
and to character offsets in the text as it was given.

The automaton goes to the executors as a list of windows, so its size is checked first: a benchmark with more
than `max_window_bytes` of windows is dealt out by item to several automata, each within the bound, that scan one
after another and add to the same row. Nothing is joined or shuffled in either case.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, table, text_bytes

WINDOW = 10
MAX_WINDOW_BYTES = 8 << 20

#: Lower-cases A-Z and turns what separates words into spaces; one byte for each byte, so offsets stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def windows_of(text: bytes | None, window: int = WINDOW) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, windows: list[tuple[bytes, list[str]]]):
    """Built once in each worker process. Bytes go in as Latin-1 characters, one for one."""
    if key not in _automata:
        if len(_automata) > 8:
            _automata.clear()
        made = ahocorasick.Automaton()
        for w, items in windows:
            made.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, items))
        if windows:
            made.make_automaton()
        _automata[key] = made
    return _automata[key]


def scan(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """(first word, word after the last) of every occurrence, and the items whose windows occur."""
    if not words or not len(automaton):
        return [], set()
    text = f" {b' '.join(words).decode('latin-1')} "
    found = [(end, n, items) for end, (n, items) in automaton.iter(text)]
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    stops = np.searchsorted(spaces, [end for end, _, _ in found]).tolist()
    return [(stop - n, stop) for stop, (_, n, _) in zip(stops, found, strict=True)], {x for _, _, items in found for x in items}


def _union(spans) -> list[int]:
    """Flat list of start, stop of the union of half-open ranges."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _character_spans(text: bytes, hits: list[int]) -> list[dict]:
    """Word ranges as ranges of code points in the text as given."""
    if not hits:
        return []
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    leads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    before = lambda i: int(leads[i - 1]) if i else 0
    return [{"start": before(at[a][0]), "stop": before(at[b - 1][1])} for a, b in zip(hits[::2], hits[1::2], strict=True)]


#: What a scan appends to a row: the text's bytes, words, words hit, their ranges (start, stop, start ...), items.
SCANNED = ["binary", "long", "long", "array<int>", "array<string>"]


def _scanner(key: str, windows):
    def run(batches):
        automaton = _automaton(key, windows.value)
        for batch in batches:
            n = batch.num_columns
            counts, n_hits, hits, items = [], [], [], []
            for text, h, i in zip(batch.column(n - 5), batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                spans, found = scan(automaton, words)
                counts.append(len(words))
                hits.append(_union([*spans, *zip(h[::2], h[1::2], strict=True)]))
                n_hits.append(sum(hits[-1][1::2]) - sum(hits[-1][::2]))
                items.append(sorted(found.union(i)))
            more = [pa.array(counts, pa.int64()), pa.array(n_hits, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 4], *more], names=batch.schema.names)

    return run


def _spans(batches):
    """Of doc_id, bytes, n_words, n_hit, ranges, items: the ranges in characters instead of bytes and ranges."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        spans = [_character_spans(t.as_py(), h) if h else [] for t, h in zip(batch.column(1), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(5), pa.array(spans, kind)], ["doc_id", "n_words", "n_hit", "items", "spans"])


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, max_window_bytes: int) -> tuple[DataFrame, list[str]]:
    """`docs` with what a scan appends, and the names of those columns."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text"))
    # Each word is in at most `window` windows of its item.
    size = items.agg(F.sum(F.octet_length("text") * F.lit(window))).first()[0] or 0
    parts = max(1, -(-size // max_window_bytes))
    names: list[str] = []
    out, none = docs, F.array()
    for name, value in zip(("bytes", "n_words", "n_hit", "hits", "items"), (text_bytes(), F.lit(0), F.lit(0), none, none), strict=True):
        names.append(fresh(out, name))
        out = out.withColumn(names[-1], value.cast(SCANNED[len(names) - 1]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for k in range(parts):
        of: dict[bytes, set[str]] = defaultdict(set)
        for row in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).toLocalIterator():
            for w in windows_of(row["text"] and bytes(row["text"]), window):
                of[w].add(row["item"])
        windows = spark.sparkContext.broadcast([(w, sorted(x)) for w, x in of.items()])
        out = out.mapInArrow(_scanner(uuid.uuid4().hex, windows), kinds)
    return out, names


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_window_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """One row per row of `docs`, which needs doc_id and text; `benchmark` needs item_id and text.

    Gives doc_id, n_words, n_hit (words inside occurrences of windows), items (the ids, as strings, sorted, of items
    with occurring windows), spans (ranges of code points of the text that are hit) and contaminated. Null and empty
    texts, and texts without a word, have no words and no hits. Items without a word have no window; a null item_id
    counts as an item named ''; items with one id are one. Further columns on either side are ignored. With an empty
    benchmark nothing is hit, and an empty table of documents gives no rows.
    """
    out, names = _scanned(docs.select("doc_id", "text"), benchmark, window, max_window_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = out.select("doc_id", *names).mapInArrow(_spans, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of the benchmark occurs. No row is shuffled."""
    out, names = _scanned(docs, benchmark, WINDOW, MAX_WINDOW_BYTES)
    return out.filter(F.col(names[2]) == 0).select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same by joining windows as text, for each length that a window has.
SQL = {
    "op2_decontamination": rf"""
WITH t AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
b AS (SELECT coalesce(id::VARCHAR, '') AS item, words, least({WINDOW}, len(words)) AS n, unnest(range(1, greatest(1, len(words) - {WINDOW - 1}) + 1)) AS i FROM w WHERE side = 'b' AND len(words) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS win FROM b),
l AS (SELECT DISTINCT n FROM v),
p AS (SELECT r, words, l.n, unnest(range(1, len(words) - l.n + 2)) AS i FROM w, l WHERE side = 'd' AND len(words) >= l.n),
h AS (SELECT p.r, p.i, p.n, v.item FROM p JOIN v ON p.n = v.n AND array_to_string(p.words[p.i : p.i + p.n - 1], ' ') = v.win),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT w.id AS doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN m USING (r) WHERE side = 'd'"""
}
