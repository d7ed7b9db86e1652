"""Ordered computations without one global sort: running totals, ranks and exact prefixes of an order.

An order is a bucket (a coarse key, monotone in the order) and a fine key inside it. Totals of buckets are summed
first; their running sum is over one row a bucket, and rows are sorted inside their bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive ids that one task orders.
ID_BUCKET = 10_000


def hash_key(key: Column | str, seed: int | Column) -> Column:
    """A reproducible random order: md5 of the key and the seed, as hexadecimal text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(":"), F.lit(seed).cast("string")))


def id_bucket(key: str, width: int = ID_BUCKET) -> Column:
    return F.floor(F.col(key) / width)


def hash_bucket(hashed: Column, digits: int = 3) -> Column:
    """The first hexadecimal digits: 4096 buckets by default."""
    return F.substring(hashed, 1, digits)


def running_totals(df: DataFrame, bucket: Column, by: list[str], values: dict[str, Column]) -> DataFrame:
    """df with columns named by values: each one's sum over all rows before, in the order of bucket, then by (which must tell rows apart).

    df is read twice, for the buckets' totals and for the rows; where its columns are dear, write them first (settle).
    """
    names = list(values)
    df = df.withColumns({"_bucket": bucket} | {f"_v{i}": values[n] for i, n in enumerate(names)})
    totals = df.groupBy("_bucket").agg(*[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))])
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # one row a bucket
    before = totals.select(F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_s{i}") for i in range(len(names))])
    inside = W.partitionBy("_bucket").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    placed = df.withColumns({f"_i{i}": F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)) for i in range(len(names))}).join(before, F.col("_bucket").eqNullSafe(F.col("_b")))
    placed = placed.withColumns({n: F.col(f"_s{i}") + F.col(f"_i{i}") for i, n in enumerate(names)})
    return placed.drop("_bucket", "_b", *[f"_{x}{i}" for x in "vsi" for i in range(len(names))])


def running_total(df: DataFrame, bucket: Column, by: list[str], value: Column, into: str) -> DataFrame:
    """running_totals of one value."""
    return running_totals(df, bucket, by, {into: value})


def rank_by_hash(df: DataFrame, key: str, seed: int, into: str = "rank") -> DataFrame:
    """df with each row's place (from 0) in the random order of seed."""
    hashed = df.withColumn("_h", hash_key(key, seed))
    return running_total(hashed, hash_bucket(F.col("_h")), ["_h", key], F.lit(1).cast("long"), into).drop("_h")


def with_row_ids(df: DataFrame, by: list[str], into: str = "idx") -> DataFrame:
    """df with row numbers from 0 in the order of by; for tables without an id. Ranges are sorted, not the whole."""
    ranged = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    from querysieve.sources.io import settle

    ranged = settle(ranged)  # so that both passes see the same ranges
    return running_total(ranged, F.col("_part"), by, F.lit(1).cast("long"), into).drop("_part")
