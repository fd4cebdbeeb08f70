"""The version log: (path, seq, op, size, timestamp), append-only, seq rising."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvid.sources.storage import written


def _last(log: DataFrame) -> DataFrame:
    v = F.struct("seq", *[c for c in log.columns if c not in ("path", "seq")])
    return log.groupBy("path").agg(F.max_by(v, "seq").alias("v")).select("path", "v.*")


def append(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh versions (without seq) after those there are, in order of timestamp, path and then all other columns.

    Numbers come from the sizes of sorted ranges, not from one sorted task. The ranges are written before they are
    counted, so that a lost executor cannot deal rows anew.
    """
    start = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]
    order = ["timestamp", "path", *sorted(c for c in fresh.columns if c not in ("timestamp", "path"))]
    rows = fresh.repartitionByRange("timestamp", "path").sortWithinPartitions(*order)
    rows = written(rows.withColumns({"part": F.spark_partition_id(), "mono": F.monotonically_increasing_id()}), "versions")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("mono").alias("lo"))
    # A row a range, of which there are as many as shuffle partitions.
    before = F.sum("n").over(W.orderBy("part")) - F.col("n")
    first = sizes.select("part", (before + F.lit(start) + 1 - F.col("lo")).alias("shift"))
    new = rows.join(F.broadcast(first), "part").withColumn("seq", (F.col("mono") + F.col("shift")).cast("long"))
    return log.unionByName(new.select(*log.columns))


def latest(log: DataFrame) -> DataFrame:
    return _last(log)


def as_of(log: DataFrame, cursor: int) -> DataFrame:
    """Each file's last version up to a cursor."""
    return _last(log.where(F.col("seq") <= cursor))


def changes_since(log: DataFrame, cursor: int) -> DataFrame:
    """Each file's last version after a cursor."""
    return _last(log.where(F.col("seq") > cursor))


def history(log: DataFrame, keep: int = 100) -> DataFrame:
    """At most `keep` versions of each file, the latest ones."""
    w = W.partitionBy("path").orderBy(F.desc("seq"))
    return log.withColumn("k", F.row_number().over(w)).where(F.col("k") <= keep).drop("k")


def hot(log: DataFrame, limit: int = 10) -> DataFrame:
    """Files by their latest change."""
    return log.groupBy("path").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"), "path").limit(limit)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, kind (created, modified, deleted) between two tables of (path, mtime, size, hash): equal times or, at equal size, equal hashes mean no change."""
    a = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("mtime", "size", "hash")], F.lit(True).alias("o"))
    b = new.select("path", "mtime", "size", "hash", F.lit(True).alias("n"))
    j = a.join(b, "path", "full")
    same = F.col("mtime").eqNullSafe(F.col("o_mtime")) | (F.col("size").eqNullSafe(F.col("o_size")) & F.col("hash").eqNullSafe(F.col("o_hash")))
    kind = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "deleted").when(~same, "modified")
    return j.select("path", kind.alias("kind")).where("kind is not null")
