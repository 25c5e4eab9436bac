"""Operators against plain Python over the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import catalogue, components, decontamination, html, language, licenses, line_dedup, mixing, quality, simhash, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# SimHash


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    least = {}
    for x in nodes:
        least[root(x)] = min(least.get(root(x), x), x)
    return {x: least[root(x)] for x in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "cc", "é", "Ünder", "x\x85y", " ", "0"]), max_size=30))
def test_fingerprints(words):
    text = " \t".join(words)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_components_of_documents(spark, sf, docs):
    rows = simhash.op9_simhash(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{plain_fingerprint(d['text']):016x}" for i, d in docs.items()}
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    want = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"] for r in simhash.keep_one_of_each(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == set(want.values())


def drifting(n, seed):
    """Fingerprints in clusters: each differs from an earlier one by up to six bits; one cluster is dense."""
    rng, out = random.Random(seed), [x << 20 for x in range(60)]
    while len(out) < n:
        x = rng.choice(out[-50:]) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


def lists_of(prints):
    rows = sorted((m, p & m, p) for p in prints for m in (int(np.int64(x).astype(np.uint64)) for x in simhash.MASKS))
    rows.sort(key=lambda r: (r[1], r[0]))
    return np.array([(r[0], r[2]) for r in rows], np.uint64)


@pytest.mark.parametrize("longest", [4, 7, 2048])
def test_index_finds_all_links(monkeypatch, longest):
    """Whatever the bound on a list, forests and pairs of blocks connect what links connect."""
    monkeypatch.setattr(simhash, "MAX_RUN", longest)
    prints = drifting(250, 3)
    rows = lists_of(prints)
    batches = [pa.RecordBatch.from_arrays([pa.array(part[:, i].view(np.int64)) for i in (0, 1)], ["mask", "fp"]) for part in np.array_split(rows.copy(), 40)]
    found = [pa.Table.from_batches([b]).to_pylist() for b in simhash._link_lists(iter(batches))]
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    pairs, rest = [], defaultdict(lambda: defaultdict(list))
    for r in (r for part in found for r in part):
        if r["chunk"] is None:
            pairs.append((unsigned(r["a"]), unsigned(r["b"])))
        else:
            rest[r["b"], r["a"] & r["b"]][r["chunk"]].append(r["a"])
    blocks = []
    for (mask, entry), chunks in rest.items():
        assert all(len(c) <= longest for c in chunks.values())
        blocks += sorted((mask, entry, i, j, x) for i in chunks for j in chunks if i <= j for x in {*chunks[i], *chunks[j]})
    if blocks:
        batch = pa.RecordBatch.from_arrays([pa.array([b[k] for b in blocks], pa.int64()) for k in (0, 4, 2, 3)], ["mask", "fp", "i", "j"])
        pairs += [(unsigned(r["a"]), unsigned(r["b"])) for out in simhash._link_blocks(iter([batch.slice(0, 7), batch.slice(7)])) for r in pa.Table.from_batches([out]).to_pylist()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    links = [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4]
    assert roots(prints, pairs) == roots(prints, links)
    assert bool(rest) == (longest < 2048)


def test_every_pair_that_reaches_the_minimum_meets():
    """Any four of the eight positions have one of the lists' three among them."""
    assert len(simhash.POSITION_SETS) == 20
    assert all(any(set(ps) <= set(four) for ps in simhash.POSITION_SETS) for four in combinations(range(8), 4))


def test_oversized_lists(spark):
    """Lists that are split by a fourth position, and what is too long even then; a hub with most edges."""
    rng = random.Random(9)
    dense = sorted({0xABCDEF << 40 | rng.getrandbits(12) << 4 | k for k in range(16) for _ in range(40)} | {0xABCDEF << 40 | rng.getrandbits(40) for _ in range(2600)})
    prints = drifting(200, 4) + dense
    found = simhash.links(spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long").repartition(3)).collect()
    pairs = [(r["a"] & 0xFFFFFFFFFFFFFFFF, r["b"] & 0xFFFFFFFFFFFFFFFF) for r in found]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    values = np.array(prints, np.uint64)
    links = [(int(x), int(y)) for k, x in enumerate(values) for y in values[k + 1 :][np.bitwise_count(values[k + 1 :] ^ x) <= 4]]
    assert roots(prints, pairs) == roots(prints, links)


def test_components_of_hubs(spark):
    edges = [(1, i) for i in range(2, 3000)] + [(5000, i) for i in range(2500, 3500)] + [(7000, 7001)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert found == {**{i: 1 for i in [*range(2, 3500), 5000]}, 7001: 7000}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 400)] + [(1000, 999), (999, 998), (5, 5), (998, 1000)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(2, 401)}, 1000: 998, 999: 998}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# Decontamination


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_leaks(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, found = norm(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("bound", [8 << 20, 20_000])
def test_leaks(spark, sf, docs, bound):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    extra = {10**6: "x. " + items[0][1].upper() + " y", 10**6 + 1: items[1][1][:40]}
    texts = {**{i: d["text"] for i, d in docs.items()}, **extra}
    rows = decontamination.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench, max_window_bytes=bound).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in rows} == plain_leaks(texts, items)
    assert any(r["contaminated"] for r in rows)
    for r in rows:
        spanned = [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]]
        assert sum(len(norm(x)) for x in spanned) == r["n_hit"]
    short = decontamination.op2_decontamination(spark, sf).filter("n_items = 0").first()
    assert short["items_sha256"] == hashlib.sha256(b"").hexdigest()


# Quality


def test_quality_counts(spark, sf, docs):
    rows = {r["doc_id"]: r for r in quality.op1_quality_rules(spark, sf).collect()}
    for i, d in docs.items():
        t = d["text"]
        w = WORD.findall(t)
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])


def test_windows_whose_hashes_meet(spark, monkeypatch):
    """Windows count as equal by their words, also where all hashes are the same."""
    texts = ["a b c x a b c", "a b c a b d a b c a b d", "a a a a", "a a b a a b a a", "a b c d e f g h", "ab c d a bc d", "b a b a b a", "", None, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counts = lambda: [r["n_repeat_words"] for r in quality.measured(df).orderBy("doc_id").collect()]
    want = []
    for t in texts:
        w = (t or "").split()
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        want.append(len({p for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for p in (k, k + 1, k + 2)}))
    assert counts() == want
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    # Equal hashes make every text a candidate, as one equal pair does otherwise.
    assert counts() == want


def test_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r["quality"]: r["s"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05


# Mixing


def nearest(sizes, budget):
    """How far from the budget the nearest sum of some of the sizes is."""
    reached = 1
    for n in sizes:
        reached |= reached << n
    return min(abs(k - budget) for k in range(reached.bit_length()) if reached >> k & 1)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 4), max_size=5), st.integers(0, 400))
def test_knapsack_is_exact(counts, budget):
    lengths = sorted(counts)
    taken = mixing.fit(lengths, [counts[x] for x in lengths], budget)
    assert all(0 <= t <= counts[x] for t, x in zip(taken, lengths, strict=True))
    total = sum(t * x for t, x in zip(taken, lengths, strict=True))
    every = sum(x * n for x, n in counts.items())
    assert abs(total - budget) == (nearest([x for x, n in counts.items() for _ in range(n)], budget) if budget < every else budget - every)


def test_large_budgets_are_met():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 3000) for _ in range(5000))
    lengths = sorted(counts)
    total = sum(counts.elements())
    for share in (0.1, 0.5, 0.93):
        budget = int(total * share)
        taken = mixing.fit(lengths, [counts[x] for x in lengths], budget)
        assert sum(a * b for a, b in zip(lengths, taken, strict=True)) == budget
        assert all(0 <= t <= counts[x] for t, x in zip(taken, lengths, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 10**6), st.integers(1, 3), min_size=1, max_size=4), st.floats(0, 1))
def test_long_documents(counts, share):
    """The nearest sum, as long as the programme has the whole budget or at most two documents are taken before it."""
    lengths = sorted(counts)
    every = [x for x, n in counts.items() for _ in range(n)]
    budget = int(sum(every) * share)
    taken = mixing.fit(lengths, [counts[x] for x in lengths], budget)
    assert all(0 <= t <= counts[x] for t, x in zip(taken, lengths, strict=True))
    total, best = sum(t * x for t, x in zip(taken, lengths, strict=True)), min(abs(sum(x * k for x, k in zip(lengths, ks, strict=True)) - budget) for ks in product(*[range(counts[x] + 1) for x in lengths]))
    assert abs(total - budget) == best if budget <= mixing.KEEP else abs(total - budget) <= max(lengths) / 2


def test_budgets_that_long_documents_meet():
    assert mixing.fit([140_000, 150_000], [3, 3], 290_000) == [1, 1]
    assert mixing.fit([200_000], [10], 980_000) == [5]
    # No sum is odd; memory doesn't grow with the number of lengths.
    taken = mixing.fit([2 * x for x in range(10, 300)], [50] * 290, 100_001)
    assert abs(sum(2 * x * t for x, t in zip(range(10, 300), taken, strict=True)) - 100_001) == 1


def test_a_mix_of_long_documents(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(140_000, "a"), (150_000, "a"), (140_000, "a"), (10, "b"), (700_000, "c")])]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[rows[r["doc_id"]][2]] += r["size"]
        taken[rows[r["doc_id"]][2]] += r["taken"]
    assert_near(sizes, taken, plain_targets(sizes), lambda s: [x["size"] for x in found if rows[x["doc_id"]][2] == s])


def test_many_sources(spark):
    sizes = {f"host{k:04d}": 1 + k * k % 977 for k in range(700)} | {None: 5000}
    rows = [(("1" if s is None else "0" + s), n) for s, n in sizes.items()]
    found = {r["skey"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "skey string, source_size long").repartition(5)).collect()}
    assert found == pytest.approx({("1" if s is None else "0" + s): x for s, x in plain_targets(sizes).items()})


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    whole, out = sum(sizes.values()), {}
    open_ = list(names)
    while open_:
        left = whole - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return out


def assert_near(sizes, taken, want, of):
    """Each source as near its target as whole documents can come."""
    for s, n in sizes.items():
        repeats = int(want[s] // n) if n else 0
        assert abs(taken[s] - want[s]) <= (nearest(of(s), round(want[s] - repeats * n)) if repeats < 3 else 0) + 1


def test_mix(spark, sf, docs):
    rows = [(i, d["text"], d["source"]) for i, d in docs.items()]
    rows += [(10**6 + k, "a b c", s) for k, s in enumerate(["tiny", None, "Z", "é", "tiny"])] + [(10**7, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    of, sizes, taken = {i: s for i, _, s in rows}, defaultdict(int), defaultdict(int)
    for i, _, s in rows:
        sizes[s] += size[i]
        taken[s] += found[i]["taken"]
    want = plain_targets(sizes)
    for i, r in found.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[of[i]] and r["target"] == pytest.approx(want[of[i]])
        assert r["taken"] <= 3 * size[i] and (not size[i] or r["taken"] % size[i] == 0)
    assert_near(sizes, taken, want, lambda s: [size[i] for i in size if of[i] == s])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in found.items()}


# Language


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def segmentations(word, place):
    """The pieces of each segmentation of a word."""
    for cuts in range(1 << len(word) - 1):
        ends = [i + 1 for i in range(len(word) - 1) if cuts >> i & 1] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if all(x in place for x in parts):
            yield [place[x] for x in parts]


def test_forward_sums_all_segmentations():
    pieces = language.vocabulary(VOCABULARY)
    rng = np.random.default_rng(1)
    p = rng.random((len(pieces), 2)) / len(pieces)
    place = {x: k for k, x in enumerate(pieces)}
    words = [b"the", b"a", "über".encode(), b"zzqx", b"tion", b"international", b"responsibility"]
    assert any(len(x) > 8 and (x[1:] if x[:1] == b" " else x) in words for x in pieces)
    found = language.log_likelihoods(language.Model(["a", "b"], pieces, p), language.Trie(pieces), [*words, language.CONTINUED + b"tion"])
    want = [sum(np.prod(p[s], axis=0) for s in segmentations(w, place)) for w in [*(b" " + w for w in words), b"tion"]]
    assert np.allclose(np.exp(found), want)


def test_expectation_maximisation():
    """A round's probabilities are the expected counts over all segmentations, listed."""
    counts = {"a": Counter({b"the": 3, b"then": 1, b"over": 2}), "b": Counter({b"the": 1, "für".encode(): 4})}
    pieces = language.vocabulary(VOCABULARY)
    place = {x: k for k, x in enumerate(pieces)}
    p = np.full((len(pieces), 2), 1 / len(pieces))
    for _ in range(2):
        expected = np.zeros_like(p)
        for k, lang in enumerate("ab"):
            for word, n in counts[lang].items():
                ways = list(segmentations(b" " + word, place))
                weights = [np.prod(p[s, k]) for s in ways]
                for s, x in zip(ways, weights, strict=True):
                    for piece in s:
                        expected[piece, k] += n * x / sum(weights)
        p = np.maximum(expected / expected.sum(axis=0), language.FLOOR)
    assert np.allclose(language.train(counts, VOCABULARY, rounds=2).probabilities, p)


def test_long_words_are_cut_between_letters():
    word = ("ü" * 5 + "日" * 25 + "a" * 40).encode()
    parts = language.pre_tokens(b"x " + word + b" y")
    assert parts[0] == b"x" and parts[-1] == b"y" and all(x.startswith(language.CONTINUED) for x in parts[2:-1])
    assert b"".join(x.removeprefix(language.CONTINUED) for x in parts[1:-1]) == word
    assert all(len(x.removeprefix(language.CONTINUED)) <= language.MAX_WORD and x.decode() for x in parts)


def test_predictions_against_enumeration(spark):
    """Whole texts: each word's probability as the listed sum."""
    counts = {"de": Counter(b"der die und ist ein".split()), "en": Counter(b"the and is of one".split())}
    model = language.train(counts, VOCABULARY)
    place = {x: k for k, x in enumerate(model.pieces)}
    for text in ("the one", "und ein", "is ist", "ab cd ef", "die and"):
        logs = sum(np.log(sum(np.prod(model.probabilities[s], axis=0) for s in segmentations(b" " + w, place))) for w in text.encode().split())
        share = np.exp(logs - logs.max())
        lang, score = language.Scorer(model).predict(text.encode())
        assert lang == model.languages[int(np.argmax(share))] and score == pytest.approx(share.max() / share.sum())
    # Equal scores: the first name.
    assert language.Scorer(language.train({"b": counts["en"], "a": counts["en"]}, VOCABULARY)).predict(b"the one") == ("a", 0.5)


def test_more_languages_than_documents_to_learn_from(spark):
    rows = [(i, f"word{'abcdefghij'[i % 10]} number", f"lang{i}") for i in range(30)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARY, max_docs=5)
    assert model.languages == sorted(lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5)
    assert (model.probabilities.max(axis=0) > 0.01).all()


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


# Token counts


@pytest.fixture(scope="module")
def splitter():
    return token_counts.Splitter(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "'s", "'LL", "é", " ", "\x1c", " ", "ſ", "1", "!", "日", "\U0001f600", "ª²", "×÷¼"]), max_size=25).map("".join))
def test_tokens_as_the_library(splitter, text):
    special, pre_tokens = splitter.split(text)
    assert special + sum(splitter.pieces(pre_tokens)) == len(splitter.library.encode(text, add_special_tokens=False).ids)


def test_pre_tokens_of_common_characters(splitter):
    """The pattern's letters and numbers are the library's, by every character that it is used for."""
    for c in filter(token_counts.COMMON.fullmatch, map(chr, range(0x2100))):
        text = f"a{c}1{c}.{c} {c}"
        assert token_counts.PATTERN.findall(text) == [text[a:b] for _, (a, b) in splitter.library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


@pytest.mark.parametrize("frequent", [token_counts.FREQUENT, 100, 0])
def test_tokens_of_documents(spark, docs, splitter, frequent):
    """Whatever part of the pre-tokens is joined by shuffle."""
    texts = {**{i: d["text"] for i, d in docs.items()}, 10**6: "日本語のテキスト" * 30 + " <|endoftext|>x", 10**6 + 1: "y" * 5000 + " z"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), frequent=frequent).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["n_bytes"] == len(text.encode())
        assert r["n_tokens"] == len(splitter.library.encode(text, add_special_tokens=False).ids) and r["over_limit"] == (r["n_tokens"] > 512)


# Toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def plain_boost(x, y, w, rounds, depth, rate, penalty, bins):
    """Margins of the rows learned from, by trying every cut on every row."""
    edges = [sorted(set(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]))) for c in x.T]
    share = sum(w * y) / sum(w)
    margin = [np.log(share / (1 - share))] * len(y)
    w = [v * len(w) / sum(w) for v in w]

    def grow(rows, level, g, h, out):
        total = lambda part: (sum(g[i] for i in part), sum(h[i] for i in part))
        worth = lambda part: total(part)[0] ** 2 / (total(part)[1] + penalty)
        if level == depth:
            out.update({i: -rate * total(rows)[0] / (total(rows)[1] + penalty) for i in rows})
            return
        best, left = 1e-6, rows
        for f in range(x.shape[1]) if len(rows) > 1 else ():
            for e in edges[f]:
                low = [i for i in rows if x[i, f] <= e]
                gain = worth(low) + worth([i for i in rows if x[i, f] > e]) - worth(rows)
                if gain > best + 1e-12:
                    best, left = gain, low
        grow(left, level + 1, g, h, out)
        grow([i for i in rows if i not in left], level + 1, g, h, out)

    for _ in range(rounds):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        values: dict[int, float] = {}
        grow(list(range(len(y))), 0, [w[i] * (p[i] - y[i]) for i in range(len(y))], [w[i] * p[i] * (1 - p[i]) for i in range(len(y))], values)
        margin = [m + values[i] for i, m in enumerate(margin)]
    return margin


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_a_plain_booster(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=60), rng.integers(0, 4, 60), np.zeros(60), rng.random(60)])
    y = (x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=60) > 1).astype(float)
    w = rng.choice([1.0, 2.5], 60)
    made = toxicity.boost(x, y, w, rounds=6, depth=3, bins=8)
    assert made.margin(x) == pytest.approx(plain_boost(x, y, w, 6, 3, 0.15, 1.0, 8), abs=1e-9)


def test_isotonic_rates_rise():
    rng = np.random.default_rng(2)
    m = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at, rates = toxicity.isotonic(m, y, np.ones(300))
    assert (np.diff(at) > 0).all() and (np.diff(rates) > 0).all() and abs(np.interp(1.5, at, rates) - 0.95) < 0.15


def test_obfuscated_words_count():
    f = toxicity.Features({})
    plain, hidden, spaced = (dict(zip(toxicity.FEATURES, f(t), strict=True)) for t in (b"you are an idiot", b"you are an id1ot", b"you are an i d i o t"))
    assert plain["near_second_person"] > 0 and hidden["obfuscated_hits"] > 0 and spaced["obfuscated_hits"] > 0


# Line dedup


def plain_dedup(texts):
    """texts: {id: text}, ids distinct. {id: (text that is left, lines taken out)}."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        filled = [(k, x, len(WORD.findall(x))) for k, x in enumerate(lines) if WORD.search(x)]
        gone, run = set(), []

        def finished():
            if len(run) > 1 and sum(w for _, _, w in run) >= line_dedup.MIN_WORDS:
                gone.update(range(run[0][0], run[-1][0] + 1))  # noqa: B023

        for n, line in enumerate(filled):
            if line[2] >= line_dedup.MIN_WORDS:
                gone.update([line[0]] if line[1] in seen else [])
                seen.add(line[1])
            if n and (filled[n - 1][1], line[1]) in seen:
                run.append(line)
            else:
                finished()
                run = [line]
            if n:
                seen.add((filled[n - 1][1], line[1]))
        finished()
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def shared_passages(texts):
    """[(id, first line, last line)] of the longest runs of lines with 50 words or more that an earlier text has as such a
    run, lines without a word left out; all lines compared."""
    filled = {i: [(x, len(WORD.findall(x))) for x in t.split("\n") if WORD.search(x)] for i, t in texts.items()}
    where, out = defaultdict(list), []
    for i in sorted(filled):
        own, n = filled[i], 0
        while n < len(own):
            longest = 0
            for j, k in where[own[n][0]]:
                size = 0
                while n + size < len(own) and k + size < len(filled[j]) and own[n + size][0] == filled[j][k + size][0]:
                    size += 1
                longest = max(longest, size)
            if sum(w for _, w in own[n : n + longest]) >= 50:
                out.append((i, [x for x, _ in own[n : n + longest]]))
            n += max(1, longest)
        for k, (x, _) in enumerate(own):
            where[x].append((i, k))
    return out


def passages(rng, n):
    """Texts of invented lines, with passages of one to eight lines and some 60 words in several of them, and frequent short lines."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [[line(60 // size + 1) for _ in range(size)] for size in (1, 2, 2, 3, 4, 5, 6, 8)]
    often = [line(3) for _ in range(3)]
    texts = {}
    for i in range(n):
        parts = [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 2)):
            parts[(at := rng.randint(0, len(parts))) : at] = rng.choice(shared)
        parts[(at := rng.randint(0, len(parts))) : at] = rng.choices([*often, "", " "], k=2)
        texts[i] = "\n".join(parts)
    return texts


@pytest.mark.parametrize("bound", [line_dedup.MAX_BROADCAST, 0])
def test_line_dedup(spark, sf, docs, bound):
    texts = {i: d["text"] for i, d in docs.items()}
    passage = "\n".join(f"shared line number {k} of a passage" for k in range(12))
    texts |= {10**6 + k: f"own start {k}\n{passage}\nown end {k}" for k in range(4)}
    texts |= {10**7 + k: t for k, t in passages(random.Random(3), 60).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    rows = line_dedup.dedup_lines(df, removed_col="n_removed", max_broadcast=bound).collect()
    want = plain_dedup(texts)
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows} == want
    assert all(want[10**6 + k] == (f"own start {k}\nown end {k}", 12) for k in (1, 2, 3)) and want[10**6][1] == 0


def test_shared_passages_go(spark):
    """Of the words of passages of 50 words or more that an earlier text has; and what no other text has stays."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"]}
    texts |= {10**7 + k: t for k, t in passages(random.Random(4), 300).items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r["doc_id"]: Counter(r["text"].split("\n")) for r in line_dedup.dedup_lines(df).collect()}
    words, stayed = 0, 0
    for i, run in shared_passages(texts):
        for x in run:
            words += len(WORD.findall(x))
            stayed += len(WORD.findall(x)) * (left[i][x] > 0)
    assert words > 10_000 and stayed / words < 0.1
    often = Counter(x for t in texts.values() for x in set(t.split("\n")))
    for i, t in texts.items():
        alone = Counter(x for x in t.split("\n") if often[x] == 1)
        assert all(left[i][x] == min(1, n) or n > 1 for x, n in alone.items())


def test_line_dedup_is_native(spark, sf):
    plan = line_dedup.op7_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# HTML


PAGE = "<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body><nav><ul>{nav}</ul></nav><div class=\"ad\">Buy {n}</div>{main}<footer>&copy; {n}</footer></body></html>"


def article(n):
    return f"<article><h1>Title {n}</h1>" + "".join(f"<p>Text {n}&nbsp;{k}  <b>bold</b>\n word</p>" for k in range(n % 5 + 1)) + '<div class="share">Share</div></article>'


def wrapper_of(pages):
    return html.infer(pages, fan_in=2)


def test_articles():
    pages = [PAGE.format(nav="<li>a</li>" * (n % 3 + 1), n=n, main=article(n)) for n in range(8)]
    wrapper = wrapper_of(pages[:6])
    for n, p in enumerate(pages):
        assert html.extract(p, wrapper) == "\n".join([f"Title {n}", *[f"Text {n} {k} bold word" for k in range(n % 5 + 1)]])


def test_without_an_article_fixed_texts_go():
    """Nothing is marked: the wrapper knows the text that all pages of the host share."""
    body = "<body><div id=c1><div>Call us any time for a quote today</div><div><p>Own words {n} of page {n} that differ a lot {n}</p><p>More of {n} and so on {n} again</p></div></div></body>"
    pages = [body.format(n=n) for n in range(5)]
    wrapper = wrapper_of(pages)
    assert html.extract(pages[3], wrapper) == "Own words 3 of page 3 that differ a lot 3\nMore of 3 and so on 3 again"


def test_folding_and_alignment():
    page = html.Page("<ul><li>1<li>2<li>3</ul><div><section>a</section><p>b</p><section>c</section><p>d</p></div>")
    assert [n[0] for n in page.parts] == ["ul", "div"] and [n[:2] for n in page.parts[0][3]] == [["li", True]]
    assert [n[:2] for n in page.parts[1][3]] == [["(section,p)", True]] and page.slots == [[0, 1, 2], [3, 5], [4, 6]]
    one, group = ([[x, False, False, []] for x in ("a", "section", "p", "b")], [["a", False, False, []], page.parts[1][3][0], ["b", False, False, []]])
    assert html.align(group, one) == [(0, 1, 0, 1), (1, 1, 1, 2), (2, 1, 3, 1)]


def test_malformed_pages():
    assert html.extract("<article><p>a<p>b<!-- open", None) == "a\nb"
    assert html.extract("<nav>menu<article>text</article>", None) == "text"
    assert html.extract("<main>a<img class='ad'>b<p class='notice'>no<p>c</p><p class=share>no</p>d <span class='advert'>no</span>e</main>", None) == "ab\nc\nd\ne"
    assert html.extract("<div class='site-header'>no</div><div id=post><div class='entry-header'><h1>t</h1></div><p>long enough text here</p></div><ul class=menu><li>no</ul>", None) == "t\nlong enough text here"
    assert html.extract("<article>x<script>if (a<b) {}</article>", None) == "x"
    assert html.extract("<main>1 &lt; 2 &#233; <i>in</i>line<br>next<section class='user-comments'>no</section></main>", None) == "1 < 2 é inline\nnext"


def article_of(source):
    body = re.search(r"<article>(.*)</article>", source, re.S)[1]
    parts = (" ".join(__import__("html").unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", body))
    return "\n".join(x for x in parts if x)


def test_pages_of_the_table(spark, sf):
    rows = html.op8_html_extraction(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        assert r["text"] == article_of(r["html"]) and r["n_chars"] == len(r["text"])


# Licenses


def test_patience_pairs_equal_words_in_order():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh").encode() for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x < y for p, q in zip(pairs, pairs[1:], strict=False) for x, y in zip(p, q, strict=True))
        assert licenses.patience(a, a) == [(i, i) for i in range(len(a))]


def test_licenses_in_texts():
    templates = [licenses.Template(n, t, 0.8) for n, t in licenses.TEMPLATES.items()]
    filler = " ".join(f"filler{i} and the words of" for i in range(300))
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        less = " ".join(w for k, w in enumerate(words) if k % 12 != 5) if len(words) > 40 else text
        for body in (text, text.upper(), less):
            found = licenses.scan(f"{filler} é {body} {filler}\n{body}".encode(), templates)
            assert sum(f["license"] == name for f in found) == 2, name
            at = next(f for f in found if f["license"] == name)
            assert body == less != text or f"{filler} é {body}"[at["start"] : at["stop"]].split()[-1].strip('."),/') == body.split()[-1].strip('."),/')
    assert licenses.scan(filler.encode(), templates) == []


def test_license_lines_of_documents(spark, sf, docs):
    lines = {"mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-nc-4.0-notice", "all-rights-reserved"}
    for r in licenses.op10_license_scan(spark, sf).collect():
        text = docs[r["doc_id"]]["text"]
        assert set(filter(None, r["licenses"].split(","))) == {n for n in lines if licenses.TEMPLATES[n] in text}
        assert r["n_found"] == sum(text.count(licenses.TEMPLATES[n]) for n in lines)


def test_the_catalogue():
    assert [sum(n.startswith(f"op{k}_") for n in catalogue.queries()) for k in range(1, 11)] == [1] * 10
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
