"""SimHash near-duplicates: 64-bit fingerprints, linked where at most `max_bits` bits differ.

Links come from a byte-position inverted index with count filtering. At most 4 differing bits touch at most 4 of the 8
bytes, so linked fingerprints share at least 4 positional bytes; that is the guaranteed minimum. The posting list of a
single byte would hold a 256th of all fingerprints, and tallying its pairs would grow with the square of the corpus. So
each list is split by two further positions: a list is of three positions and their bytes. Not all 56 sets of three are
needed, as 20 of them are such that any four positions have one of them among them. Of each pair that meets in a list the shared
positional bytes are tallied, pairs that reach the minimum are retained, and their differing bits are counted.

The index holds distinct fingerprints: exact copies are one entry each. A list is never expanded into all its
pairs: short lists give their linked pairs once; longer ones give a spanning forest of their links; lists over MAX_RUN are
split by a fourth position, and what is longer even then is dealt out as pairs of blocks, so that no task holds more than two blocks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, join_counted, materialise, table, text_bytes
from tidemark.llm.components import connected_components, popcount

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BYTES = 8
#: Positional bytes that two linked fingerprints share at least.
MIN_SHARED = BYTES - MAX_BITS
#: Shingles that are tallied at a time.
BLOCK = 1 << 16
#: Entries of a posting list that one task compares; longer lists go on as pairs of blocks of this size.
MAX_RUN = 2048

#: Turan's sets: the positions in three groups in a circle; all of one group, or two of one and one of the next.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def _position_sets() -> list[tuple[int, ...]]:
    after = {p: set(GROUPS[(g + 1) % len(GROUPS)]) for g, group in enumerate(GROUPS) for p in group}
    group_of = {p: set(group) for group in GROUPS for p in group}
    return [ps for ps in combinations(range(BYTES), MIN_SHARED - 1) if any(len(group_of[p] & set(ps)) == 3 or (len(group_of[p] & set(ps)) == 2 and len(after[p] & set(ps)) == 1) for p in ps)]


def _mask(positions) -> int:
    """As a signed long, the type of Spark's columns."""
    return int(np.uint64(sum(0xFF << 8 * p for p in positions)).astype(np.int64))


POSITION_SETS = _position_sets()
MASKS = [_mask(ps) for ps in POSITION_SETS]
#: By the set of shared positions, as the bits of a byte: the mask of the first list that holds the pair; 0 below the minimum.
FIRST = np.array([next((_mask(ps) for ps in POSITION_SETS if all(x >> p & 1 for p in ps)), 0) if x.bit_count() >= MIN_SHARED else 0 for x in range(1 << BYTES)], np.int64).view(np.uint64)

_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit fingerprint. Words are what ASCII white space separates, A-Z lower-cased; a text of fewer
    than four words is one shingle; a text without words, or null, has fingerprint zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    n, counts, digest = len(ends), np.zeros((8, 8), np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], "<u8")
        by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
        counts += by_byte @ _BIT_OF_BYTE
    return int(np.packbits((2 * counts.ravel() > n), bitorder="little").view("<u8")[0])


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _fingerprint_batches(batches):
    """Rows (id, hash, text's bytes) with the fingerprint in the place of the bytes."""
    for batch in batches:
        prints = _signed([fingerprint(x.as_py()) for x in batch.column(2)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["doc_id", "mark", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): each row's id, a hash that tells its text from others with that id, and the signed long of
    its fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), text_bytes(text_col).alias("fp"))
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, mark long, fp long")


def _tally(x: np.ndarray) -> np.ndarray:
    """Of differences of fingerprints: the positions in which the bytes agree, as the bits of a byte."""
    return np.packbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, BYTES) == 0, axis=1, bitorder="little").ravel()


def _links(x: np.ndarray) -> np.ndarray:
    """Which differences are of linked pairs: enough shared positional bytes, and then few enough bits."""
    out = FIRST[_tally(x)] != 0
    out[out] = popcount(x[out]) <= MAX_BITS
    return out


def _forest(values: np.ndarray) -> tuple[list, list]:
    """Edges of a spanning forest of the links among `values`."""
    rest, a, b = values, [], []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = _links(rest ^ x)
            if near.any():
                found, rest = rest[near], rest[~near]
                a += [int(x)] * len(found)
                b += found.tolist()
                frontier += list(found)
    return a, b


def _linked(mask: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prints: np.ndarray):
    """Edges of complete posting lists that lie one after another in `prints`."""
    for n in (2, 3, 4):
        at = starts[sizes == n]
        for i in range(n):
            for j in range(i + 1, n):
                x, y = prints[at + i], prints[at + j]
                ok = _links(x ^ y)
                x, y, m = x[ok], y[ok], mask[at[ok]]
                # In the lists of three positions a pair counts in the first that holds it.
                once = (FIRST[_tally(x ^ y)] == m) | (popcount(m) > 8 * (MIN_SHARED - 1))
                if once.any():
                    yield x[once].tolist(), y[once].tolist()
    for at, n in zip(starts[sizes > 4].tolist(), sizes[sizes > 4].tolist(), strict=True):
        a, b = _forest(prints[at : at + n])
        if a:
            yield a, b


def _edges(a, b) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.nulls(n, pa.int32())], ["a", "b", "chunk"])


def _link_lists(batches):
    """Rows (mask, fp), sorted so that each posting list lies together. Gives edges (a, b, null) and, of lists
    over MAX_RUN, their entries (fp, mask, chunk)."""
    held: np.ndarray | None = None
    going: tuple | None = None  # the list whose earlier chunks have already been passed on
    chunk = 0

    def passed(rows, number):
        return pa.RecordBatch.from_arrays([_signed(rows[:, 1]), _signed(rows[:, 0]), pa.array(np.full(len(rows), number), pa.int32())], ["a", "b", "chunk"])

    def dealt(rows, first):
        for k in range(0, len(rows), MAX_RUN):
            yield passed(rows[k : k + MAX_RUN], first + k // MAX_RUN)

    def groups(rows):
        keys = rows[:, 1] & rows[:, 0]
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (rows[1:, 0] != rows[:-1, 0])) + 1
        return np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))

    def finished(rows):
        nonlocal going, chunk
        if not len(rows):
            return
        starts, stops = groups(rows)
        if going is not None:
            key = (int(rows[0, 0]), int(rows[0, 0] & rows[0, 1]))
            if key == going:
                yield from dealt(rows[: stops[0]], chunk)
                starts, stops = starts[1:], stops[1:]
            going, chunk = None, 0
        sizes = stops - starts
        for a, b in zip(starts[sizes > MAX_RUN].tolist(), stops[sizes > MAX_RUN].tolist(), strict=True):
            yield from dealt(rows[a:b], 0)
        starts, sizes = starts[sizes <= MAX_RUN], sizes[sizes <= MAX_RUN]
        for a, b in _linked(np.ascontiguousarray(rows[:, 0]), starts, sizes, np.ascontiguousarray(rows[:, 1])):
            yield _edges(a, b)

    for batch in batches:
        rows = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1)])
        if not len(rows):
            continue
        rows = rows if held is None else np.concatenate((held, rows))
        starts, _ = groups(rows)
        last = int(starts[-1])
        yield from finished(rows[:last])
        held = rows[last:]
        while len(held) > MAX_RUN:
            key = (int(held[0, 0]), int(held[0, 0] & held[0, 1]))
            going, chunk = key, chunk if going == key else 0
            yield passed(held[:MAX_RUN], chunk)
            held, chunk = held[MAX_RUN:], chunk + 1
    if held is not None:
        yield from finished(held)


def _link_blocks(batches):
    """Rows (mask, fp, i, j), sorted so that each pair of blocks of a list lies together: its spanning forest."""
    held = None
    for batch in batches:
        rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(4)])
        rows = rows if held is None else np.concatenate((held, rows))
        keys = np.column_stack((rows[:, 0], rows[:, 1] & rows[:, 0], rows[:, 2], rows[:, 3]))
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        ends = [0, *cut.tolist()]
        for a, b in zip(ends, ends[1:], strict=False):
            x, y = _forest(rows[a:b, 1])
            if x:
                yield _edges(x, y)
        held = rows[ends[-1] :]
    if held is not None and len(held):
        x, y = _forest(held[:, 1])
        if x:
            yield _edges(x, y)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect whatever links connect."""
    entry = F.col("fp").bitwiseAND(F.col("mask"))
    schema = "a long, b long, chunk int"

    def listed(index: DataFrame) -> DataFrame:
        return materialise(index.repartition(entry, F.col("mask")).sortWithinPartitions(entry, "mask").mapInArrow(_link_lists, schema))

    def oversized(found: DataFrame) -> DataFrame:
        """Of an oversized list's entries, a is the fingerprint and b the mask."""
        return found.filter("chunk is not null").select(F.col("a").alias("fp"), F.col("b").alias("mask"), "chunk")

    found = listed(prints.select(F.explode(F.array(*[F.lit(m).cast("long") for m in MASKS])).alias("mask"), "fp"))
    # A pair that reaches the minimum shares a further position beside those of a list of three.
    more = F.filter(F.transform(F.array(*[F.lit(_mask([p])).cast("long") for p in range(BYTES)]), lambda p: F.col("mask").bitwiseOR(p)), lambda m: m != F.col("mask"))
    split = listed(oversized(found).select(F.explode(more).alias("mask"), "fp"))
    rest = oversized(split)
    chunks = rest.groupBy("mask", entry.alias("entry")).agg(F.max("chunk").alias("last"))
    pairs = (
        rest.withColumn("entry", entry)
        .join(chunks, ["mask", "entry"])
        .select("mask", "fp", "chunk", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        .select("mask", "fp", F.least("chunk", "other").cast("long").alias("i"), F.greatest("chunk", "other").cast("long").alias("j"))
    )
    blocks = pairs.repartition("mask", entry, "i", "j").sortWithinPartitions("mask", entry, "i", "j").mapInArrow(_link_blocks, schema)
    return found.unionByName(split).filter("chunk is null").unionByName(blocks).select("a", "b")


def classes(rows: DataFrame) -> DataFrame:
    """(fp, n, component, component_id) for every distinct fp of `rows` (doc_id, fp): how many rows have it; the smallest
    of the fingerprints reachable by links; and the smallest doc_id of their rows, null if none has an id."""
    heads = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
    part = connected_components(links(heads.select("fp")))
    part = part.unionByName(part.select(F.col("component").alias("node"), "component").distinct())
    inside = materialise(heads.join(part.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "head"))
    least = inside.groupBy("component").agg(F.min("head").alias("least"), F.count("*").alias("n"))
    linked = join_counted(inside, least, "component", "n", inside.count()).select("fp", "component", "least")
    alone = F.col("component").isNull()
    return heads.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), F.when(alone, F.col("head")).otherwise(F.col("least")).alias("component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and link like any other text. A null id takes part, but is never
    the smallest of a component unless all its ids are null. Repeated rows each get a row. An empty table gives
    none. Further columns are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col))
    of = materialise(classes(rows))
    # Exact copies share a fingerprint, so one may have a large part of all rows.
    return join_counted(rows, of, "fp", "n", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, less all but one row of each component: the one of the smallest id stays, a
    null id last; of rows with that id, the one of the smallest 64-bit hash of the text; of repeated rows, one."""
    names = [fresh(docs, x) for x in ("kept_id", "kept_mark")]
    rows = materialise(fingerprints(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    # First of each fingerprint, then of each component; both are combined before their shuffle.
    first = rows.groupBy("fp").agg(F.min(order).alias("best"))
    kept = first.join(classes(rows), "fp").groupBy("component").agg(F.min("best").alias("best"))
    kept = kept.select(F.col("best.id").alias(names[0]), F.col("best.mark").alias(names[1]))
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1])))
    return joined.dropDuplicates(names).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
