"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts, as a Java and Python regular expression: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't have, whatever columns its user brought."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which the driver and all executors share.

    Outside a cluster, where the setting is absent, a temporary folder takes its place; on a cluster a missing setting
    is an error, because a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder. Only narrow tables (ids, hashes, counts) go
    through here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, keep: list, columns: list) -> DataFrame:
    """The columns `keep` and the computed `columns` (with names), these by way of a generator of one row for each row.

    Catalyst would otherwise put their expressions in the place of their names in any later filter, push that down and
    compute them again in it, once for each mention within mentions; a filter isn't pushed below a generator.
    """
    name = fresh(df, "settled")
    out = df.select(*keep, F.explode_outer(F.array(F.struct(*columns))).alias(name))
    return out.select(*[F.col(c) for c in out.columns if c != name], f"{name}.*")


def id_remainder(column: str, divisor: int):
    """crc32 of the id's text, modulo `divisor`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes, so that Python neither decodes it twice nor meets what it can't decode."""
    return F.col(column).cast("binary")


#: A key is hot if it has more than this share of all rows; so there are fewer than 1 / HOT hot keys, which are broadcast.
HOT = 0.001


def join_counted(rows: DataFrame, known: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """`rows` joined with the row of `known` that each `key` has; known's column `count` says how many of `total` rows the
    key has, and is dropped. Rows of hot keys meet a broadcast of these keys' rows where they are, the others by shuffle,
    so no task gets more than its share of a key. Both frames are read twice. Null keys match none."""
    hot = F.col(count) > HOT * total
    few = F.broadcast(known.filter(hot).drop(count))  # fewer than 1 / HOT rows
    rest = rows.join(few.select(key), key, "left_anti").join(known.filter(~hot).drop(count), key)
    return rows.join(few, key).unionByName(rest)
