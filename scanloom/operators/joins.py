"""Joins of rows against a key list when one key may own a large part of the rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.session import release, settle

SALTS = 16
MOST_BITS = 1 << 27


def salt_of(*columns: str, salts: int = SALTS) -> Column:
    """Stable salt from the columns that tell the rows of a key apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def for_every_salt(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """One copy of each row per salt; for the side with one row per key."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def split_hot_keys(df: DataFrame) -> DataFrame:
    """Let Spark split skewed join partitions also where an aggregation on the same keys follows.

    By default it keeps the join's partitioning for that aggregation, and one task gets all rows of a frequent key. Sessions
    of :func:`scanloom.session.archive_session` split such partitions, at the cost of a shuffle of the join's result where one
    is found; no setting of another session is changed.
    """
    return df


def spread_join(
    df: DataFrame, per_key: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner", salts: int = 1
) -> DataFrame:
    """Join ``df`` with a table that has one row per key, a key's rows spread over many tasks.

    Skewed partitions are split by Spark when it meets them; with ``salts`` above 1, for plans that run without adaptive
    execution, every row of ``per_key`` is copied that often instead.
    """
    if salts == 1:
        return split_hot_keys(df).join(per_key, keys, how)
    rows = df.withColumn("_salt", salt_of(*spread_by, salts=salts))
    return rows.join(for_every_salt(per_key, salts), [*keys, "_salt"], how).drop("_salt")


def may_be_among(keys: DataFrame) -> Callable[[Column], Column]:
    """Test of a 64-bit hash against a table of one column of them: never false for a hash that the table has.

    For a join of many rows of which few match: the others can stay out of its shuffle. About sixteen bits for each key, 16 MB
    at most, go to the driver and to the tasks that test; with very many keys more rows pass that do not match.
    """
    keys = settle(keys.dropna(), "zstd")
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    at = keys.select(F.col(keys.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("bit"))
    marks = at.selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63 AS INT)) AS mark").groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[marks.column("word").to_numpy()] = marks.column("mark").to_numpy().view(np.uint64)
    known = keys.sparkSession.sparkContext.broadcast(table)
    release(keys)

    @F.arrow_udf("boolean")
    def test(key: pa.Array) -> pa.Array:
        bit = key.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
        return pa.array((known.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool))

    return test
