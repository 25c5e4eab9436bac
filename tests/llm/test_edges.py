"""Odd rows through every operator: a row out for a row in, defined values, no crash; empty tables give none."""

from __future__ import annotations

import public_tokenizers
import pytest

from tests.llm import cases
from tidemark.llm import decontamination, html, language, licenses, line_dedup, mixing, quality, simhash, token_counts, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = public_tokenizers.path("byte_bpe_50k.json")

ROW_FOR_ROW = {
    "quality": lambda s, d: quality.quality_rules(d),
    "decontamination": lambda s, d: decontamination.leaks(d, cases.benchmark(s)),
    "mixing": lambda s, d: mixing.mix(d),
    "language": lambda s, d: language.language_id(d, VOCABULARY),
    "token_counts": lambda s, d: token_counts.count_tokens(d, BPE),
    "toxicity": lambda s, d: toxicity.toxicity(d, cases.labels(s)),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d, removed_col="n_removed"),
    "simhash": lambda s, d: simhash.simhash_components(d),
    "licenses": lambda s, d: licenses.license_scan(d),
}
FILTERS = {
    "language": lambda s, d: language.keep_known(d, VOCABULARY),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d, length_col="n_chars"),
    "simhash": lambda s, d: simhash.keep_one_of_each(d),
    "decontamination": lambda s, d: decontamination.drop_leaks(d, cases.benchmark(s)),
}


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_a_row_for_each_row(spark, name):
    docs = cases.docs(spark)
    rows = ROW_FOR_ROW[name](spark, docs).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids == sorted((t[0] is None, t[0] or 0) for t in cases.TEXTS)


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_an_empty_table(spark, name):
    assert ROW_FOR_ROW[name](spark, cases.docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_stages_keep_all_columns(spark, name):
    docs = cases.docs(spark)
    out = FILTERS[name](spark, docs)
    assert out.dtypes == docs.dtypes
    assert all(r["score"] == "clash" for r in out.collect())
    assert FILTERS[name](spark, cases.docs(spark, [])).collect() == []


def test_mixing_keeps_all_columns(spark):
    docs = cases.docs(spark).drop("copies", "taken")
    assert mixing.take(docs).columns == [*docs.columns, "copies", "taken"]
    assert mixing.take(cases.docs(spark)).columns == [*cases.docs(spark).columns, "_copies", "_taken"]
    assert mixing.take(cases.docs(spark, [])).collect() == []


def test_pages(spark):
    pages = cases.pages(spark)
    rows = {r["page_id"]: r for r in html.extract_pages(pages).collect()}
    assert html.extract_pages(pages).count() == 7
    assert rows[1]["text"] == "T\nOne & two"
    assert rows[2]["text"] == rows[3]["text"] == "" and rows[2]["n_chars"] == 0
    assert rows[None]["text"] == "plain text < not a tag"
    assert rows[4]["text"] == "deep"
    assert html.extract_pages(pages.limit(0)).collect() == []


def test_values_of_odd_texts(spark):
    docs = cases.docs(spark)
    words = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert words[2]["n_words"] == words[3]["n_words"] == words[4]["n_words"] == 0 and words[2]["base_failed"] and not words[2]["kept"]
    langs = {r["doc_id"]: r for r in language.language_id(docs, VOCABULARY).collect()}
    assert [langs[i]["lang_pred"] for i in (2, 3, 4, 5)] == ["und"] * 4 and langs[2]["score"] == 0
    assert langs[10]["lang_pred"] != "und"
    counts = {r["doc_id"]: r for r in token_counts.count_tokens(docs, BPE).collect()}
    assert (counts[2]["n_bytes"], counts[2]["n_tokens"]) == (0, 0)
    prints = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    assert prints[2]["fingerprint"] == prints[4]["fingerprint"] == "0" * 16 and prints[4]["component_id"] == 2
    hits = {r["doc_id"]: r for r in decontamination.leaks(docs, cases.benchmark(spark)).collect()}
    assert hits[1]["items"] == ["7"] and hits[None]["n_words"] in (0, 12) and hits[11]["items"] == [""]
    found = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in licenses.license_scan(docs).collect()}
    assert found[11] == ["mit-notice"] and found[2] == []
    passages = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, removed_col="n_removed").collect()}
    assert passages[6]["n_removed"] == 0 and passages[7]["text"] == "another opening\nanother ending" and passages[2]["text"] is None


def test_no_labels_at_all(spark):
    docs = cases.docs(spark)
    assert {r["score"] for r in toxicity.toxicity(docs, cases.labels(spark).limit(0)).collect()} == {0.0}
    assert {r["lang_pred"] for r in language.language_id(docs.withColumn("lang", docs["lang"].substr(0, 0)).filter("lang is null"), VOCABULARY).collect()} <= {"und"}


def test_no_benchmark(spark):
    docs = cases.docs(spark)
    assert decontamination.drop_leaks(docs, cases.benchmark(spark).limit(0)).count() == docs.count()
