"""Each stage of the pipeline against plain Python on its own input."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import corpus_pipeline
from tests.llm.test_brute_force import WORD, assert_near, plain_dedup, plain_fingerprint, plain_leaks, plain_targets, roots


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before, {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns and (name == "mixing" or docs.columns == columns)

    before, after = seen["language_id"]
    assert set(after) == {i for i, r in before.items() if any(map(str.isalpha, r["text"]))}

    before, after = seen["line_dedup"]
    want = plain_dedup({i: r["text"] for i, r in before.items()})
    assert {i: r["text"] for i, r in after.items()} == {i: t for i, (t, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if want[i][1])

    before, after = seen["simhash"]
    prints = {i: plain_fingerprint(r["text"]) for i, r in before.items()}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert set(after) == set(roots(prints, links).values())

    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(after) == {i for i, (_, hit, _) in plain_leaks({i: r["text"] for i, r in before.items()}, items).items() if not hit}

    before, after = seen["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, r in before.items():
        n = len(WORD.findall(r["text"]))
        sizes[r["source"]] += n
        if i in after:
            assert after[i]["copies"] >= 1 and after[i]["taken"] == after[i]["copies"] * n
            taken[r["source"]] += after[i]["taken"]
    assert_near(sizes, taken, plain_targets(sizes), lambda s: [len(WORD.findall(r["text"])) for r in before.values() if r["source"] == s])

    assert {(r["doc_id"], r["copies"]) for r in corpus_pipeline.run(spark, sf).collect()} == {(i, r["copies"]) for i, r in after.items()}
