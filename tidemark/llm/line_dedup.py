"""Line dedup by content-defined chunks, with DataFrame functions only.

A text is a sequence of lines; those without a word belong to no chunk. A rolling hash over the hashes of two
neighbouring lines is taken at every line. Chunks follow from it: a chunk goes on as long as its rolling hashes occur
earlier in the corpus, and a boundary lies where one doesn't. So boundaries depend on nothing but the lines at them: a passage
that is copied into another text is cut out whole, whatever stands before and after it. A line of MIN_WORDS words or
more has a hash of its own, too, for a passage may be a single line.

A chunk of MIN_WORDS words or more is removed; every pair of lines in it, compared byte by byte, stands at an earlier place: that of
a smaller id, then of a smaller hash of the text, then further up. The first place of a passage keeps it.

Three scans of the texts: one gives the hashes, from which the repeated ones follow by a count; one gives the lines at
repeated hashes, which are grouped by their bytes, so that equal hashes of unequal lines part; one rebuilds the texts from
which something is removed. Counts and first places are combined before the shuffle. The repeated hashes are broadcast if they are at
most MAX_BROADCAST; beyond that hot ones alone are, and texts meet the places of theirs by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh, join_counted, materialise, settled, table

MIN_WORDS = 50
#: So many repeated hashes are sent to every executor at most (as many longs).
MAX_BROADCAST = 1_000_000


def _windows(lines: Column) -> Column:
    """Of an array of lines: array<struct<k, start, stop, head, words, text>>, the pairs of neighbouring lines with a word,
    and the single lines of MIN_WORDS words. k numbers the lines with a word, start and stop are places among all
    lines, words are those of the last line and head those of the one before; head is null of a single line."""
    sized = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("w")))

    def from_filled(filled: Column) -> Column:
        def at(m: Column, k: Column) -> Column:
            before = F.get(filled, k - 1)
            pair = F.struct(k.alias("k"), before["i"].alias("start"), m["i"].alias("stop"), before["w"].alias("head"), m["w"].alias("words"), F.concat_ws("\n", before["x"], m["x"]).alias("text"))
            alone = F.struct(k.alias("k"), m["i"].alias("start"), m["i"].alias("stop"), F.lit(None).cast("int").alias("head"), m["w"].alias("words"), m["x"].alias("text"))
            none = F.lit(None).cast("struct<k:int,start:int,stop:int,head:int,words:int,text:string>")
            return F.array(F.when(k > 0, pair).otherwise(none), F.when(m["w"] >= MIN_WORDS, alone).otherwise(none))

        return F.filter(F.flatten(F.transform(filled, at)), lambda x: x.isNotNull())

    # A transform of one element gives its value a name, so that it's computed once.
    return F.get(F.transform(F.array(F.filter(sized, lambda m: m["w"] > 0)), from_filled), 0)


def _exploded(keyed: DataFrame, windows: Column) -> DataFrame:
    # An inner explode would make Catalyst infer a filter on the array's size and compute it all again in the scan.
    return keyed.select("id", "mark", F.explode_outer(windows).alias("x")).filter("x is not null").select("id", "mark", "x.*")


def ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, mark, gone): by id and hash of the text, the ranges of lines to remove, as array<struct<start, stop>>."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).filter("text is not null")
    lines = F.split("text", "\n", -1)
    # k and whether head is null name a window of a text.
    places = materialise(_exploded(keyed, _windows(lines)).select("id", "mark", "k", "start", "stop", "head", "words", F.xxhash64("text").alias("hash")))
    repeated = materialise(places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"))
    if repeated.count() <= max_broadcast:
        some = F.broadcast(repeated.select("hash"))
        suspects = places.join(some, "hash", "left_semi").drop("hash")
        texts = _exploded(keyed, _windows(lines)).withColumn("hash", F.xxhash64("text")).join(some, "hash", "left_semi")
    else:
        suspects = materialise(join_counted(places, repeated, "hash", "n", places.count()).drop("hash"))
        of = suspects.groupBy("id", "mark").agg(F.collect_set(F.struct("k", F.col("head").isNull().alias("alone"))).alias("wanted"))
        of = of.select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), "wanted")
        met = keyed.join(of, F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")))
        texts = _exploded(met, F.filter(_windows(lines), lambda x: F.array_contains("wanted", F.struct(x["k"].alias("k"), x["head"].isNull().alias("alone")))))
    at = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "k", F.col("head").isNull().alias("alone"))
    first = texts.groupBy("text").agg(F.min(at).alias("at")).select("at.*")
    s, f = suspects.withColumn("alone", F.col("head").isNull()).alias("s"), first.alias("f")
    same = F.col("s.id").eqNullSafe(F.col("f.id")) & (F.col("s.mark") == F.col("f.mark")) & (F.col("s.k") == F.col("f.k")) & (F.col("s.alone") == F.col("f.alone"))
    # Repeated rows of one document come to one.
    again = materialise(s.join(f, same, "left_anti").select("s.*").distinct())
    by = F.row_number().over(W.partitionBy("id", "mark").orderBy("k"))
    pairs = again.filter("not alone").withColumn("run", F.col("k") - by).groupBy("id", "mark", "run")
    runs = pairs.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.sum("words") + F.min_by("head", "k")).alias("total")).filter(F.col("total") >= MIN_WORDS)
    both = runs.select("id", "mark", "start", "stop").unionByName(again.filter("alone").select("id", "mark", "start", "stop"))
    return both.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None, length_col: str | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of `docs`, all columns, with repeated passages taken out of the text. `removed_col` names a further
    column for the number of lines taken out; `length_col`, if `docs` has it, is set to the new length of a text that
    has changed.

    Rows that agree in id and text (by a 64-bit hash of it) are one document: each gets the same result. A null text stays
    null, an empty one empty. A document that is all repeats keeps an empty text. Lines without a word go with a passage that they
    stand in. An empty table gives none. Within one document, too, only the first of equal passages stays.
    """
    gone = ranges(docs, id_col, text_col, max_broadcast)
    names = [fresh(docs, x) for x in ("gone_id", "gone_mark", "gone")]
    gone = gone.select(*[F.col(a).alias(b) for a, b in zip(("id", "mark", "gone"), names, strict=True)])
    hit = F.col(id_col).eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    joined = docs.join(gone, hit, "left")
    left, lost = fresh(joined, "left"), F.col(names[2])
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.exists(lost, lambda r: (i >= r["start"]) & (i <= r["stop"])))
    # Texts from which nothing goes are not cut.
    joined = joined.withColumn(left, F.when(lost.isNotNull(), kept))
    text = F.when(lost.isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    new = [text.alias(text_col)]
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new.append(F.when(lost.isNull(), F.col(length_col)).otherwise(F.length(text).cast(kind)).alias(length_col))
    if removed_col:
        removed = F.size(F.split(F.col(text_col), "\n", -1)) - F.size(left)
        new.append(F.when(lost.isNull(), F.lit(0)).otherwise(removed).cast("long").alias(removed_col))
    out = settled(joined, [c for c in docs.columns if c not in (text_col, length_col)], new)
    return out.select(*docs.columns, *([removed_col] if removed_col else []))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, and how many lines went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, removed_col="n_removed")


#: The same with strings compared instead of hashes.
SQL = {
    "op7_line_dedup": rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
f AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS w FROM l),
p AS (SELECT *, lag(line) OVER q AS line0, lag(i) OVER q AS i0, lag(w) OVER q AS w0, row_number() OVER q AS k FROM f WHERE w > 0 WINDOW q AS (PARTITION BY doc_id, text ORDER BY i)),
n AS (SELECT *, row_number() OVER (PARTITION BY line0, line ORDER BY doc_id NULLS LAST, text, i) AS nth FROM p WHERE line0 IS NOT NULL),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, text ORDER BY k) AS run FROM n WHERE nth > 1),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, text, i) AS nth FROM p WHERE w >= {MIN_WORDS}),
g AS (SELECT doc_id, text, min(i0) AS a, max(i) AS b FROM r GROUP BY doc_id, text, run HAVING sum(w) + min_by(w0, k) >= {MIN_WORDS}
      UNION ALL SELECT doc_id, text, i, i FROM o WHERE nth > 1),
k AS (SELECT l.doc_id, l.text, line, i, EXISTS (SELECT 1 FROM g WHERE g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.text = l.text AND i BETWEEN a AND b) AS goes FROM l),
t AS (SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '') AS kept, count(*) FILTER (goes) AS n_removed FROM k GROUP BY ALL)
SELECT documents.doc_id, t.kept AS text, coalesce(t.n_removed, 0)::BIGINT AS n_removed
FROM documents LEFT JOIN t ON documents.doc_id IS NOT DISTINCT FROM t.doc_id AND documents.text = t.text"""
}
