"""Sort keys, positions within groups, latest version per key.

A position inside a group is never computed by one task per group: rows are
range-partitioned over all tasks by (group, order), numbered inside each slice, and
shifted by the number of rows of the same group in earlier slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import settle


def number_or_none(col: Column) -> Column:
    """Numeric reading of a text or number column, NULL when it is not a number."""
    return col.cast("string").try_cast("double")


def compare_key(col: Column, compat: bool = False) -> Column:
    """Total order of mixed values: missing, then numbers by value, then text by locale.

    In compatible mode blank text counts as the number 0.
    """
    text = col.cast("string")
    num = number_or_none(col)
    if compat:
        num = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(num)
    rank = F.when(col.isNull(), 0).when(num.isNotNull(), 1).when(text == "", 2).otherwise(3)
    return F.struct(
        rank.alias("rank"),
        num.alias("num"),
        F.when(num.isNull(), F.collate(text, "UNICODE")).alias("text"),
        F.when(num.isNull(), text).alias("raw"),
    )


def number_last_key(number: Column, *uids: Column) -> Column:
    """Order of series and instances: by number, those without one last, ties by UID."""
    num = number_or_none(number)
    return F.struct(
        num.isNull().alias("absent"),
        num.alias("num"),
        *[u.alias(f"uid{i}") for i, u in enumerate(uids)],
    )


def study_order(date: str = "study_date", time: str | None = "study_time", uid: str = "study_uid") -> list[Column]:
    """Ascending date, time, UID; missing first.

    UIDs are digits and dots, for which byte order is the locale's order.
    """
    keys = [compare_key(F.col(c)) for c in (date, time) if c]
    return [*[k.asc() for k in keys], F.col(uid).asc_nulls_first()]


def sort_studies(studies: DataFrame) -> DataFrame:
    return studies.orderBy(*study_order(time="study_time" if "study_time" in studies.columns else None))


def same_keys(left: str, right: str, names: list[str]) -> Column:
    """Join condition on equal keys; NULL keys are one group."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names],
    )


def sliced(df: DataFrame, keys: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """Rows range-partitioned by (keys, order), with the slice number fixed in ``_slice``.

    Without a given number of slices adaptive execution sizes them; it only merges
    neighbouring ranges, so slice numbers still follow the order.
    """
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return settle(placed.withColumn("_slice", F.spark_partition_id()))


def slice_offsets(placed: DataFrame, keys: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Totals of earlier slices for groups that span slices.

    Only the first and last group of a slice can continue in another one, so the
    result has at most two rows per slice whatever the data size.
    """
    if keys:
        ends = placed.groupBy("_slice").agg(
            F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last")
        )
        border = ends.select(F.explode(F.array("first", "last")).alias("k")).select("k.*").distinct()
        part = placed.alias("p").join(F.broadcast(border.alias("b")), same_keys("p", "b", keys), "left_semi")
    else:
        part = placed
    sums = part.groupBy("_slice", *keys).agg(*[v.alias(n) for n, v in amounts.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "_slice", *keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in amounts]
    )


def _numbered(placed: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    numbered = placed.withColumn("_pos", F.row_number().over(local))
    offsets = slice_offsets(placed, keys, {"_before": F.count(F.lit(1))})
    joined = numbered.alias("n").join(
        F.broadcast(offsets.alias("o")), same_keys("n", "o", ["_slice", *keys]), "left"
    )
    position = F.col("n._pos") + F.coalesce(F.col("o._before"), F.lit(0))
    columns = [c for c in placed.columns if c != "_slice"]
    return joined.select(*[F.col(f"n.{c}") for c in columns], position.cast("bigint").alias(name))


def with_ordinal(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "ordinal", slices: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row within its group (the whole table without keys)."""
    return _numbered(sliced(df, keys, order, slices), keys, order, name)


def with_ordinal_and_totals(
    df: DataFrame, keys: list[str], order: list[Column], name: str, totals: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Positions, and aggregates per group taken from the same materialised rows."""
    placed = sliced(df, keys, order)
    sums = placed.groupBy(*keys).agg(*[v.alias(n) for n, v in totals.items()])
    return _numbered(placed, keys, order, name), sums


def latest_per_key(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Newest row per key; ``version`` is ascending and must order rows totally.

    The rank filter lets Spark keep one row per key in every map task before the
    shuffle, so a key with very many versions does not reach one task whole.
    """
    newest = Window.partitionBy(*keys).orderBy(*[v.desc_nulls_last() for v in version])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """Oldest row per key, in the same way."""
    oldest = Window.partitionBy(*keys).orderBy(*[v.asc_nulls_first() for v in version])
    return df.withColumn("_rank", F.row_number().over(oldest)).where("_rank = 1").drop("_rank")


def middle_element(
    df: DataFrame, keys: list[str], order: list[Column], frames: str | None = None
) -> DataFrame:
    """Row at index floor(n/2) of every ordered group, with its middle frame."""
    placed, sizes = with_ordinal_and_totals(df, keys, order, "position", {"group_size": F.count(F.lit(1))})
    middle = sizes.withColumn("position", F.expr("group_size div 2 + 1"))
    met = placed.alias("p").join(middle.alias("m"), same_keys("p", "m", [*keys, "position"]))
    out = met.select(*[F.col(f"p.{c}") for c in placed.columns], "m.group_size")
    if frames:
        count = F.coalesce(F.col(frames), F.lit(1))
        count = F.when(count == 0, 1).otherwise(count)
        out = out.withColumn("middle_frame", F.ceil(count / 2).cast("bigint"))
    return out
