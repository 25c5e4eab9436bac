"""Rows that every operator meets: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

from pyspark.sql import types as T

CLASHES = ["n_words", "score", "fp", "hits", "items", "kept", "taken", "copies", "gone", "chunks", "h", "skey", "bytes", "found", "mark", "component_id"]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)

PASSAGE = " ".join(f"word{i}" for i in range(60))

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf", "en", "a"),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon", "de", "b"),
    (2, None, "en", None),
    (3, "", None, "a"),
    (4, " \t\n\r ", "en", "c"),
    (5, "1234 5678 !!! ???", None, "c"),
    (6, "first line here\n" + PASSAGE + "\nsecond line", "en", "a"),
    (7, "another opening\n" + PASSAGE + "\nanother ending", "en", "b"),
    (8, "long " * 30000, "en", "b"),
    (9, "x" * 50000, None, "b"),
    (10, "日本語のテキスト ééé \U0001f600 naïve", "fr", None),
    (11, "Released under the MIT License.\nYou are an idiot", "en", "a"),
    (None, None, None, None),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["clash"] * len(CLASHES)) for i, t, lang, s in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (11, 0, 1), (11, 0, None), (None, 1, 1), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(7, "brown fox jumps over the lazy dog and runs away from"), (8, "braune Fuchs"), (None, "mit license"), (9, None), (10, ""), (8, "braune Fuchs")], "item_id long, text string")


def pages(spark):
    rows = [
        (1, "https://a.example/x", "<html><body><nav>Menu</nav><article><h1>T</h1><p>One &amp; two</article></body>"),
        (1, "https://a.example/x", "<html><body><nav>Menu</nav><article><h1>T</h1><p>One &amp; two</article></body>"),
        (2, None, None),
        (3, "nonsense", ""),
        (None, "https://b.example/", "plain text < not a tag"),
        (4, "https://c.example/", "<p>" * 20000 + "deep"),
        (5, "https://c.example/", "<div class='" + "x" * 50000),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, wrapper string")
