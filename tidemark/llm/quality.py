"""Quality rules: a table of thresholds compiled into one projection, without user functions.

RULES is the table; a rule is a name, a measure (a Spark expression over the measured counts), and the least and
greatest value that passes. verdict() turns it into one boolean expression.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, settled, table

SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages that are meant to pass.
STOP_WORDS = {
    "en": "the of and to a in is that it for as with was on be by this are from or an at not which have he they you we what",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus avec ce il elle ne se son",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este",
}

#: name, measure, least, greatest.
RULES = [
    ("words", "n_words", 50, None),
    ("mean_word_length", "word_chars / n_words", 2, 12),
    ("repeated_windows", "n_repeat_words / n_words", None, 0.5),
    ("symbols", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words / n_words", 0.06, None),
    ("shouting", "n_capitals / n_letters", None, 0.5),
    ("letters", "n_letters / word_chars", 0.6, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.34),
    ("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
]
#: The rules that make base_failed.
BASE = ("words", "repeated_windows")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that RULES use. A null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("lines"))
    window = F.when(F.size("words") > 2, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("windows", window)
    # Where windows repeat: (hash, place), sorted, so that equal hashes lie together.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("placed", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    meets = lambda list_, x, k, parts: F.exists(F.array(k + 1, k - 1), lambda j: F.coalesce(reduce(and_, [F.get(list_, j)[p] == x[p] for p in parts]), F.lit(False)))
    rows = rows.withColumn("met", F.filter("placed", lambda x, k: meets("placed", x, k, "h")))
    # Hashes only choose; windows are equal if their words are.
    rows = rows.withColumn("spelt", F.array_sort(F.transform("met", lambda x: F.struct(*[F.get("words", x["i"] + n).alias(p) for n, p in enumerate("abc")], x["i"].alias("i")))))
    rows = rows.withColumn("places", F.array_sort(F.transform(F.filter("spelt", lambda x, k: meets("spelt", x, k, "abc")), lambda x: x["i"])))
    # Each place covers three words, less what the next place covers again.
    covered = F.aggregate(
        F.transform("places", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x
    )
    listed = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    stops = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w.isin(listed))
    count = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    as_long = lambda c: c.cast("long")
    columns = [
        as_long(F.size("words")).alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        as_long(count(f"[{SYMBOLS}]+")).alias("n_symbols"),
        as_long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        as_long(F.size("lines")).alias("n_lines"),
        as_long(F.size(stops)).alias("n_stop_words"),
        as_long(count(r"\p{Lu}+")).alias("n_capitals"),
        as_long(count(r"\p{L}+")).alias("n_letters"),
        as_long(F.size(F.filter("lines", lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))))).alias("n_ellipsis_lines"),
    ]
    return settled(rows, ["doc_id"], columns)


def verdict(names=None) -> Column:
    """True where every rule of these names passes. A measure without a value, over no words or lines, passes."""
    out = F.lit(True)
    for name, measure, least, greatest in RULES:
        if names is None or name in names:
            top, _, bottom = measure.partition(" / ")
            value = F.col(top).cast("double") / F.nullif(F.col(bottom), F.lit(0)) if bottom else F.col(top)
            for bound, passes in ((least, lambda v, b: v >= b), (greatest, lambda v, b: v <= b)):
                if bound is not None:
                    out = out & F.coalesce(passes(value, F.lit(bound)), F.lit(True))
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): the counts, base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows and null ids each give a row; an empty table gives
    none; further columns are ignored.
    """
    return measured(docs).withColumn("base_failed", ~verdict(BASE)).withColumn("kept", verdict())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
    rules = []
    for _, measure, least, greatest in RULES:
        top, _, bottom = measure.partition(" / ")
        value = f"({top}::DOUBLE / nullif({bottom}, 0))" if bottom else top
        rules += [f"coalesce({value} >= {least}, true)"] if least is not None else []
        rules += [f"coalesce({value} <= {greatest}, true)"] if greatest is not None else []
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
v AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM v),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines,
        len(list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: x IN ({words}))) AS n_stop_words,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals,
        length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS n_letters,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {" AND ".join(rules)} AS kept
FROM m"""


SQL = {"op1_quality_rules": _sql()}
