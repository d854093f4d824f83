"""Two replicas brought to the same contents, comparing digests first and repeating until nothing is left to move.

Digests form a tree: object, study, bucket of studies, replica. Only the objects of studies that differ, in buckets that
differ, are read and compared; equal branches end at their digest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.dedup import set_hash
from scanloom.operators.ordering import latest_per_key
from scanloom.session import new_folder, settle


class NotConsistent(RuntimeError):
    """The bound of rounds was reached while there still was something to move."""


class Replica:
    """Objects of one side: ``(study_uid, keys, version, content_hash, ...)`` in bucket folders; added to, never changed.

    The newest version of an object counts, of equal versions the larger content hash.
    """

    def __init__(self, objects: DataFrame, keys: Sequence[str], buckets: int = 64, root: str | None = None):
        self.spark: SparkSession = objects.sparkSession
        self.keys, self.buckets = list(keys), buckets
        self.root = root or new_folder(self.spark, "replica")
        self.schema = objects.withColumn("bucket", self._bucket()).schema
        self.add(objects)
        self._studies = settle(self._study_digests(self.objects()))
        self.digests = self._bucket_digests(self._studies)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("study_uid"), F.lit(self.buckets)).cast("int")

    def add(self, objects: DataFrame) -> None:
        placed = objects.withColumn("bucket", self._bucket())
        placed.repartitionByRange("bucket", "study_uid", *self.keys).write.mode("append").partitionBy("bucket").parquet(self.root)

    def objects(self, buckets: Sequence[int] | None = None, studies: DataFrame | None = None) -> DataFrame:
        """Newest versions, of all or of some buckets, whose folders alone are read, there of all or of the given studies."""
        rows = self.spark.read.schema(self.schema).parquet(self.root)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        if studies is not None:
            rows = of_studies(rows, studies, "left_semi")
        return latest_per_key(rows, ["bucket", "study_uid", *self.keys], [F.col("version"), F.col("content_hash")])

    def _study_digests(self, objects: DataFrame) -> DataFrame:
        leaf = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in [*self.keys, "version", "content_hash"]]), 256)
        return objects.groupBy("bucket", "study_uid").agg(F.count(F.lit(1)).alias("n"), set_hash(leaf).alias("digest"))

    def _bucket_digests(self, studies: DataFrame) -> dict[int, tuple[int, str]]:
        """Objects and digest per bucket: at most ``buckets`` rows."""
        named = F.sha2(F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("="), "study_uid"), F.lit("-")), "digest"), 256)
        rows = studies.groupBy("bucket").agg(F.sum("n").alias("n"), set_hash(named).alias("digest")).collect()
        return {r["bucket"]: (r["n"], r["digest"]) for r in rows}

    def studies(self, buckets: Sequence[int]) -> DataFrame:
        return self._studies.where(F.col("bucket").isin(list(buckets)))

    def refresh(self, gained: DataFrame) -> None:
        """Digests again of the studies that got objects, and of their buckets; all other branches stay."""
        touched = settle(gained.select(self._bucket().alias("bucket"), "study_uid").distinct())
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        if not buckets:
            return
        fresh = self._study_digests(self.objects(buckets, touched))
        self._studies = settle(of_studies(self._studies, touched, "left_anti").unionByName(fresh))
        self.digests.update(self._bucket_digests(self.studies(buckets)))


def of_studies(rows: DataFrame, studies: DataFrame, how: str) -> DataFrame:
    """Rows whose ``(bucket, study_uid)`` is among the given ones, or is not; a NULL UID is one study."""
    same = (F.col("o.bucket") == F.col("s.bucket")) & F.col("o.study_uid").eqNullSafe(F.col("s.study_uid"))
    return rows.alias("o").join(studies.alias("s"), same, how)


def differing_buckets(left: Replica, right: Replica) -> list[int]:
    return sorted(b for b in left.digests.keys() | right.digests.keys() if left.digests.get(b) != right.digests.get(b))


def differing_studies(left: Replica, right: Replica, buckets: Sequence[int]) -> DataFrame:
    """``(bucket, study_uid)`` of studies in these buckets whose digests differ or that one side lacks."""
    a = left.studies(buckets).select("bucket", "study_uid", F.col("digest").alias("_a"))
    b = right.studies(buckets).select("bucket", "study_uid", F.col("digest").alias("_b"))
    same = (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.study_uid").eqNullSafe(F.col("b.study_uid"))
    met = a.alias("a").join(b.alias("b"), same, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return met.select(F.coalesce("a.bucket", "b.bucket").alias("bucket"), F.coalesce("a.study_uid", "b.study_uid").alias("study_uid"))


def moves(left: Replica, right: Replica, studies: DataFrame, buckets: Sequence[int]) -> DataFrame:
    """Objects of the given studies that one side lacks or has in an older version, with ``to`` = left or right."""
    names = [c for c in left.schema.names if c != "bucket"]
    keys = ["study_uid", *left.keys]

    def side(replica: Replica, name: str) -> DataFrame:
        return replica.objects(buckets, studies).select(F.struct(*names).alias(name), F.struct("version", "content_hash").alias(f"_{name}"), *[F.col(k).alias(f"{name}_{k}") for k in keys])

    same = reduce(lambda x, y: x & y, [F.col(f"left_{k}").eqNullSafe(F.col(f"right_{k}")) for k in keys])
    met = side(left, "left").join(side(right, "right"), same, "full_outer")
    newer = F.when(F.col("left").isNull() | (F.col("_left") < F.col("_right")), "left").when(
        F.col("right").isNull() | (F.col("_right") < F.col("_left")), "right"
    )
    rows = met.withColumn("to", newer).where("to IS NOT NULL")
    return rows.select("to", F.when(F.col("to") == "left", F.col("right")).otherwise(F.col("left")).alias("r")).select("to", "r.*")


ROUNDS = "round int, n_buckets int, n_studies bigint, n_read bigint, to_left bigint, to_right bigint"


def make_consistent(
    left: Replica, right: Replica, rounds: int = 10, meanwhile: Callable[[int], tuple[DataFrame | None, DataFrame | None]] | None = None
) -> DataFrame:
    """Move what differs in both directions until a round moves nothing; one row per round, the last one with no moves.

    ``meanwhile(round)`` gives the objects that each side received while the round ran. More than ``rounds`` rounds raise
    :class:`NotConsistent`. ``n_read`` counts the objects in buckets that differ, on both sides; no others are read. The
    driver holds one digest per bucket, a fixed number.
    """
    spark, log = left.spark, []
    for at in range(1, rounds + 1):
        buckets = differing_buckets(left, right)
        if not buckets:
            log.append((at, 0, 0, 0, 0, 0))
            return spark.createDataFrame(log, ROUNDS)
        studies = settle(differing_studies(left, right, buckets))
        moved = settle(moves(left, right, studies, buckets))
        counts = {r["to"]: r["count"] for r in moved.groupBy("to").count().collect()}
        read = sum(side.digests.get(b, (0, ""))[0] for side in (left, right) for b in buckets)
        log.append((at, len(buckets), studies.count(), read, counts.get("left", 0), counts.get("right", 0)))
        arrived = meanwhile(at) if meanwhile else (None, None)
        for replica, name, extra in ((left, "left", arrived[0]), (right, "right", arrived[1])):
            gained = moved.where(F.col("to") == name).drop("to")
            if extra is not None:
                gained = settle(gained.unionByName(extra.select(*gained.columns)))
            replica.add(gained)
            replica.refresh(gained)
    if differing_buckets(left, right):
        raise NotConsistent(f"still different after {rounds} rounds")
    return spark.createDataFrame(log, ROUNDS)
