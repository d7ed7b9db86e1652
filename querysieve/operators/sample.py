"""Splits, samples and choices that depend on ids and a seed only: any engine and any partitioning agrees on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import hash_key, rank_by_hash, running_total


def split(df: DataFrame, key: str, test_size: int | float, seed: int = 42) -> DataFrame:
    """df with split: exactly test_size rows (or that share, rounded down) are dev, the others train."""
    if isinstance(test_size, float):
        if not 0 <= test_size <= 1:
            raise ValueError("a share lies between 0 and 1")
        test_size = int(df.count() * test_size)
    if test_size < 0:
        raise ValueError("test_size is negative")
    return rank_by_hash(df, key, seed, "_rank").withColumn("split", F.when(F.col("_rank") < test_size, "dev").otherwise("train")).drop("_rank")


def first_k(df: DataFrame, k: int, category: str, key: str) -> DataFrame:
    """The k rows of least key of each category, with their rank from 1."""
    w = W.partitionBy(category).orderBy(key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bottom_k(df: DataFrame, k: int, category: str, key: str, seed: int | Column = 42) -> DataFrame:
    """A uniform sample of k rows of each category: those of least hash. Tasks keep k rows each before the shuffle."""
    w = W.partitionBy(category).orderBy("_h", key)
    return df.withColumn("_h", hash_key(key, seed)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_h")


def choose(key: Column | str, n: int | Column, salt: str) -> Column:
    """A uniform choice from 0 to n - 1 for each key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + salt))), 1, 8), 16, 10).cast("long") % n


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(hash_key(key, seed), key)


def last_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with the same key the last in the order. One row a key and task is shuffled."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def chunk_ids(rows: str, size: int) -> Column:
    return F.floor(F.col(rows) / size).cast("long")


def chunk_ranges(total: int, size: int) -> list[tuple[int, int]]:
    return [(i, min(i + size, total)) for i in range(0, total, size)]


def until(df: DataFrame, bucket: Column, by: list[str], value: Column, target: int | Column) -> DataFrame:
    """Rows in order as long as the sum before them is below the target: the row that reaches it is the last."""
    return running_total(df, bucket, by, value, "_before").where(F.col("_before") < target).drop("_before")
