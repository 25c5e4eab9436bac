"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length in words. A source whose target is r times its size and a bit gets
every document r times and a subset for the remaining budget: the same share of every length, rounded down, and a
bounded-knapsack dynamic programme over the last KEEP words, or twice the longest document's, which finds the counts of
each length that come as near the budget as any can. Of each length the documents with the smallest seeded hashes are taken, so a rerun takes
the same ones.

The programme sees one row for each length of a source, never documents. Which documents of a length are taken is
settled by SALTS ranges of the seeded hash: whole ranges are in or out by their counts, and only within a range are
documents ranked, so that one length of one source is not ranked in one task.
"""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, fresh, materialise, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Times a source's size that its target may reach.
MOST = 3
SEED = 20240115
#: Words of a budget that the dynamic programme has at least.
KEEP = 1 << 22
SALTS = 256


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near `budget` as they can; no more than
    `counts` of any.

    The programme has the last KEEP words of the budget, twice the longest document if that is more: of whatever is
    beyond, the same share of every length is taken first, and then of the longest. So it finds the nearest sum of all
    for budgets up to that, and of what is left to it for larger ones; as more words are left than the budget asks for,
    the sum is off by half the longest document at most. A length is open in binary parts. Sums are the bits of an
    integer; of its states only every so many-th is kept, and the others are computed again on the way back, so memory
    grows with the root of the number of parts."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(lengths)
    longest = max(x for x, n in zip(lengths, counts, strict=True) if n)
    keep = min(budget, max(KEEP, 2 * longest))
    taken = [c * (budget - keep) // total for c in counts]
    left = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
    order = sorted((i for i, x in enumerate(lengths) if x and counts[i]), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - taken[i], (left - keep) // lengths[i])
        taken[i] += more
        left -= lengths[i] * more
    limit = left + longest
    parts = []
    for i in order:
        spare, part = min(counts[i] - taken[i], limit // lengths[i]), 1
        while spare > 0:
            parts.append((i, min(part, spare)))
            spare, part = spare - part, part * 2
    full, every = (1 << limit + 1) - 1, isqrt(len(parts)) + 1

    def step(sums: int, k: int) -> int:
        i, part = parts[k]
        return sums | sums << lengths[i] * part & full

    # Bit s says that s words can be made of the parts so far.
    reached, kept, n = 1, [], 0
    while n < len(parts) and not reached >> left & 1:
        if n % every == 0:
            kept.append(reached)
        reached, n = step(reached, n), n + 1
    below = (reached & (1 << left + 1) - 1).bit_length() - 1
    above = reached >> left
    over = (above & -above).bit_length() - 1 if above else left + 1
    best = left + over if over < left - below else below
    while kept:
        states, first = [kept.pop()], len(kept) * every
        for k in range(first, n - 1):
            states.append(step(states[-1], k))
        for k in range(n - 1, first - 1, -1):
            if not states[k - first] >> best & 1:
                i, part = parts[k]
                taken[i] += part
                best -= lengths[i] * part
        n = first
    return taken


def _weighted(sources: DataFrame, weights) -> DataFrame:
    """Adds weight, by the place of skey among all, to one row per source. Places are counted within sorted ranges and
    the ranges' sizes added up, a row each, so no task orders all sources."""
    ranged = materialise(sources.repartitionByRange("skey").sortWithinPartitions("skey").withColumn("at", F.monotonically_increasing_id()))
    ranges = ranged.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(ranges.select("range", before.alias("start")))  # a row for each partition
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int") + 1)
    return ranged.join(starts, F.shiftright("at", 33) == F.col("range")).select("skey", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target to one row per source (skey, source_size).

    Resharing stops at the level x for which the sum of min(cap, weight * x) is all words. Each round caps the sources
    that the last one's level lifts above their cap and shares what is left of all words among the others; the level
    only rises, so capped sources stay so, and the rounds end when none is added. A round is one sum over the sources.
    """
    rows = materialise(_weighted(sources, weights).withColumn("cap", F.col("source_size") * most))
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("cap") < level * F.col("weight")
        got = rows.agg(F.sum("source_size").alias("words"), F.sum(F.when(above, F.col("cap"))).alias("caps"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if got["n"] == capped or not got["open"]:
            break
        level, capped = (got["words"] - (got["caps"] or 0)) / got["open"], got["n"]
    return rows.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("weight")).alias("target"))


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source, by length: how often every document is taken, and how many once more."""
    size, target = int(rows["source_size"].iat[0]), float(rows["target"].iat[0])
    rows = rows.sort_values("size")
    repeats = int(target // size) if size else 0
    lengths, counts = rows["size"].tolist(), rows["n"].tolist()
    return rows.assign(repeats=repeats, once_more=fit(lengths, counts, round(target - repeats * size)))[["skey", "size", "source_size", "target", "repeats", "once_more"]]


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, size (words), source_size, target (of its source),
    taken (words the mix takes of it, repeats counted).

    Null and empty texts have size 0. A null source is a source of its own, last in the order. Rows with a null or
    repeated id are documents of their own; of rows that agree in id, source and size any may be the one taken. An
    empty table gives none; further columns are ignored. A source without words has target 0.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))
    rows = docs.select("doc_id", key.alias("skey"), size.alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"))
    rows = materialise(rows).withColumn("salt", F.pmod(F.shiftrightunsigned("h", 32), F.lit(SALTS)))
    by_salt = rows.groupBy("skey", "size", "salt").agg(F.count("*").alias("n"))
    by_size = rows.groupBy("skey", "size").agg(F.count("*").alias("n"))
    by_source = targets(by_size.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    kinds = "skey string, size long, source_size long, target double, repeats long, once_more long"
    plan = by_size.join(by_source, "skey").groupBy("skey").applyInPandas(_plan, kinds)
    earlier = W.partitionBy("skey", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    quota = by_salt.join(plan, ["skey", "size"]).withColumn("quota", F.col("once_more") - F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("skey", "size", "salt").orderBy("h", "doc_id"))
    picked = rows.withColumn("rank", rank).join(quota.drop("n"), ["skey", "size", "salt"])
    copies = F.col("repeats") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)
    return picked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of `docs` that the mix takes, all columns, with copies (how often) and taken (words, copies counted).

    Rows are told apart by id and a 64-bit hash of the text: of rows that agree in both, one stays, with the copies of all of them, and
    counts as so many documents. Texts without a word are taken once, they have no words to mix."""
    mark = F.xxhash64("text")
    sized = docs.select(F.struct("doc_id", mark.alias("mark")).alias("doc_id"), "text", "source")
    names = [fresh(docs, x) for x in ("mix_id", "mix_mark", "copies", "taken")]
    mixed = mix(sized, weights, most, seed).groupBy("doc_id").agg(F.sum(F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(1)).alias("n"), F.sum("taken").alias("t"))
    mixed = mixed.filter("n > 0").select(F.col("doc_id.doc_id").alias(names[0]), F.col("doc_id.mark").alias(names[1]), F.col("n").alias(names[2]), F.col("t").alias(names[3]))
    hit = F.col("doc_id").eqNullSafe(F.col(names[0])) & (mark == F.col(names[1]))
    joined = docs.join(mixed, hit).dropDuplicates(names[:2])
    return joined.select(*docs.columns, *names[2:])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
