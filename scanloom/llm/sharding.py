"""Resharding by minimum-cost flow: new shards of given capacities with the fewest bytes moved."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.session import new_folder, settle

PLACE = ("old_shard", "shard", "slot")
PART_BYTES = 32 << 20  # of one shard that one task writes


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Amounts from each old shard to each new one that place all of ``supply`` at the least total cost.

    Successive shortest paths with potentials over the bipartite network; costs are not negative and ``capacity`` holds
    the whole supply at least.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    m, n = len(supply), len(capacity)
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    high = [0] * (m + n)
    while any(left):
        far = [0 if i < m and left[i] else 1 << 62 for i in range(m + n)]
        via = [-1] * (m + n)
        queue = [(0, i) for i in range(m) if left[i]]
        while queue:
            d, v = heapq.heappop(queue)
            if d > far[v]:
                continue
            if v < m:
                edges = ((m + j, cost[v][j]) for j in range(n))
            else:
                edges = ((i, -cost[i][v - m]) for i in range(m) if flow[i][v - m])
            for w, c in edges:
                if (e := d + c + high[v] - high[w]) < far[w]:
                    far[w], via[w] = e, v
                    heapq.heappush(queue, (e, w))
        end = min((m + j for j in range(n) if room[j]), key=lambda v: far[v] + high[v])
        high = [h + min(f, far[end]) for h, f in zip(high, far)]
        path = [end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - m])
        for v, w in zip(path, path[1:]):
            if v >= m:
                amount = min(amount, flow[w][v - m])
        for v, w in zip(path, path[1:]):
            if v < m:
                flow[v][w - m] += amount
            else:
                flow[w][v - m] -= amount
        left[path[0]] -= amount
        room[end - m] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def reshard(rows: DataFrame, old: Column, size: Column, shards: int, capacity: Sequence[int] | None = None,
            key: Column | None = None, blocks: int = 1024) -> DataFrame:
    """Adds ``old_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard) to ``rows``; a column of ``rows`` with such a
    name gets underscores at its end. All columns travel along, once through a shuffle by pieces of the new shards.

    ``old`` is the number of the present shard (new ones of the same number keep its files), ``size`` the bytes of a row;
    ``capacity`` defaults to equal bytes. The rows of an old shard are dealt into ``blocks`` blocks by ``key``'s hash;
    block sizes (``blocks`` numbers for each old shard, whatever the input) go to the driver, which solves the flow and
    lays the blocks end to end along each old shard's outgoing amounts. Only a block that lies across a border is cut
    between rows, each row going where its middle byte lies, so a shard misses its capacity by a row at each border.
    No step sorts or numbers a whole shard.
    """
    spark = rows.sparkSession
    names = free_names(rows.columns)
    rows = settle(rows.select(
        F.struct(*[F.col(f"`{a}`").alias(b) for a, b in zip(rows.columns, names)]).alias("_doc"),
        old.cast("int").alias("_old"), size.cast("bigint").alias("_size"),
        F.pmod(F.xxhash64(key if key is not None else F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ), compression="zstd")
    counted = sorted(rows.groupBy("_old", "_block").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).collect())
    n_old = max([r["_old"] for r in counted], default=-1) + 1
    supply = [0] * n_old
    for r in counted:
        supply[r["_old"]] += r["bytes"]
    capacity = list(capacity) if capacity is not None else equal_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(shards)] for i in range(n_old)])
    plan, at = [], [0] * n_old
    edges = [np.cumsum([0, *f]) for f in flow]
    for r in counted:
        i, low = r["_old"], at[r["_old"]]
        high = at[i] = low + r["bytes"]
        for j in range(shards):
            if flow[i][j] and (edges[i][j] < high or low == high) and edges[i][j + 1] > low:
                plan.append((i, r["_block"], j, int(edges[i][j] - low), int(edges[i][j + 1] - low), r["bytes"]))
    schema = "_old int, _block int, shard int, _from bigint, _to bigint, _bytes bigint"
    parts = spark.createDataFrame(plan, schema)  # bounded: blocks and borders
    whole = F.broadcast(parts.where("_from <= 0 and _to >= _bytes").select("_old", "_block", "shard"))
    cut = F.broadcast(parts.where("not (_from <= 0 and _to >= _bytes)").drop("_bytes"))
    inside = Window.partitionBy("_old", "_block").orderBy("_row")
    middle = F.sum("_size").over(inside) - F.col("_size") / 2
    split = rows.join(cut.select("_old", "_block").distinct(), ["_old", "_block"], "left_semi").withColumn("_middle", middle) \
        .join(cut, ["_old", "_block"]).where("_middle >= _from and _middle < _to").drop("_middle", "_from", "_to")
    placed = rows.join(whole, ["_old", "_block"]).unionByName(split)
    groups = settle(placed.groupBy("shard", "_old", "_block").agg(F.count("*").alias("n")))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_old", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("shard", "_old", "_block", first.alias("_first"))  # bounded like the plan
    parts = min(blocks, max(1, -(-sum(supply) // (shards * PART_BYTES))))
    placed = placed.withColumn("_part", F.col("_block") % parts).repartition(2 * shards * parts, "shard", "_part")
    nth = F.row_number().over(Window.partitionBy("shard", "_part", "_old", "_block").orderBy("_row")) - 1
    return placed.withColumn("_nth", nth).join(F.broadcast(groups), ["shard", "_old", "_block"]).select(
        "_doc.*", F.col("_old").alias("old_shard"), "shard", (F.col("_first") + F.col("_nth")).cast("bigint").alias("slot")
    )


def free_names(columns: Sequence[str]) -> list[str]:
    """``columns``, those that would clash with ``PLACE`` with underscores at their end."""
    taken, out = {*PLACE, *(c.lower() for c in columns)}, []
    for c in columns:
        if c.lower() in PLACE:
            while c.lower() in taken:
                c += "_"
            taken.add(c.lower())
        out.append(c)
    return out


def text_bytes() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def source_shard(old_shards: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(old_shards)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, old_shards: int = 12, blocks: int = 1024) -> DataFrame:
    """Every document's place after moving from ``old_shards`` shards by source to ``shards`` of near-equal bytes.

    ``docs`` needs doc_id, text and source; other columns are ignored. Returns per input row doc_id, size (UTF-8 bytes
    plus 1), text_crc32, law (``bytes``), shard, slot, grown_shard (NULL: only the ``key`` law has one) and old_shard.
    The old shards are those a job left that wrote one file set for each source hash, so a hot source fills one of them.
    NULL texts count as empty, NULL sources as a source of their own; repeated rows and NULL ids get places of their
    own; equal texts are not kept together, for a large group of copies would break the equal sizes; an empty table
    gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text_bytes()) + 1).cast("bigint").alias("size"),
        F.crc32(text_bytes().cast("binary")).alias("text_crc32"), source_shard(old_shards).alias("old"),
    )
    return described(reshard(rows, F.col("old"), F.col("size"), shards, blocks=blocks), F.col("size"), F.col("text_crc32"))


def described(rows: DataFrame, size: Column, crc: Column) -> DataFrame:
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), size.cast("bigint").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def reshard_documents(docs: DataFrame, shards: int = 16, old_shards: int = 12, blocks: int = 1024, path: str | None = None) -> DataFrame:
    """``shard_documents`` with the files: the new shards are written, whole rows with all columns, below ``path`` (default: a
    new folder), and the result is read from them.

    The old shards are those ``shard_documents`` has; as the table does not lie in shards yet, those that keep their
    files are laid down first, then the ones that change are written over what is there.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "shards")
    rows = reshard(docs, source_shard(old_shards), F.octet_length(text_bytes()) + 1, shards, blocks=blocks)
    moves = rows.groupBy("old_shard", "shard").agg(F.count("*").alias("n")).collect()  # old times new shards at most
    changed = {x for r in moves if r["old_shard"] != r["shard"] for x in (r["old_shard"], r["shard"])}
    if stays := sorted({r["shard"] for r in moves} - changed):
        write_shards(rows, stays, path)
    write_shards(rows, sorted(changed), path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return described(stored, F.octet_length(text_bytes()) + 1, F.crc32(text_bytes().cast("binary")))


def write_shards(rows: DataFrame, shards: Sequence[int], path: str) -> None:
    """Write ``shards`` of ``rows`` as folders ``shard=n`` below ``path``. Other folders stay; one of ``shards`` without rows ends up empty."""
    there = rows.where(F.col("shard").isin(*shards)) if shards else rows.limit(0)
    there.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    full = {r["shard"] for r in rows.where(F.col("shard").isin(*shards)).select("shard").distinct().collect()} if shards else set()
    for n in sorted(set(shards) - full):  # dynamic overwriting leaves folders that get no rows
        rows.drop("shard").limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/shard={n}")


def rewrite(docs: DataFrame, places: DataFrame, path: str) -> DataFrame:
    """Write the shards that change, as folders ``shard=n`` below ``path``; returns (shard, n_in, n_out).

    ``places`` is what ``shard_documents`` gave for ``docs``. Rows find their places by id, text size and crc32; the rows
    that agree in them, NULL ids too, share out their places one by one. A shard none of whose rows comes or goes keeps
    its files, and one that loses all its rows is left empty. ``docs`` must not be read from ``path``.
    """
    places = settle(places)
    moved = places.where("old_shard <> shard")
    traffic = moved.select(F.explode(F.array(
        F.struct(F.col("shard").alias("shard"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out")),
        F.struct(F.col("old_shard").alias("shard"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out")),
    )).alias("x")).groupBy("x.shard").agg(F.sum("x.n_in").alias("n_in"), F.sum("x.n_out").alias("n_out"))
    traffic = settle(traffic)
    names = free_names(docs.columns)
    same = ["_id", "_size", "_crc"]
    given = docs.select(
        F.struct(*[F.col(f"`{a}`").alias(b) for a, b in zip(docs.columns, names)]).alias("_doc"), F.col("doc_id").cast("bigint").alias("_id"),
        (F.octet_length(text_bytes()) + 1).cast("bigint").alias("_size"), F.crc32(text_bytes().cast("binary")).alias("_crc"),
    ).withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("_doc"))))
    wanted = places.select(F.col("doc_id").alias("id"), F.col("size").alias("bytes"), F.col("text_crc32").alias("crc"), *PLACE) \
        .withColumn("nth", F.row_number().over(Window.partitionBy("id", "bytes", "crc").orderBy("shard", "slot")))
    found = given.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_size") == F.col("bytes")) & (F.col("_crc") == F.col("crc"))
                       & (F.col("_nth") == F.col("nth")))
    part = F.floor(F.col("slot") / 100_000)
    rows = found.select("_doc.*", *PLACE).repartition("shard", part).sortWithinPartitions("shard", "slot")
    write_shards(rows, sorted(r["shard"] for r in traffic.collect()), path)  # at most one row for each shard
    return traffic
