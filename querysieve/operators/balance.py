"""Balancing, injecting and mixing of clean and dirty blocks; quotas of the one-pass builder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.sources.io import settle

from .order import hash_bucket, hash_key, id_bucket, rank_by_hash, running_totals
from .sample import until
from .tokens import Tokenizer, pack, tokenize


def _tokens(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum(F.size("input_ids").cast("long")), F.lit(0))).first()[0]


def _take(blocks: DataFrame, target: int, seed: int, key: str) -> DataFrame:
    """Blocks in random order until they hold target tokens."""
    hashed = blocks.withColumn("_h", hash_key(key, seed))
    return until(hashed, hash_bucket(F.col("_h")), ["_h", key], F.size("input_ids").cast("long"), F.lit(target)).drop("_h")


def balance(clean: DataFrame, dirty: DataFrame, seed: int = 42, key: str = "block_id") -> DataFrame:
    """side, origin and the blocks' columns. The clean side stays; the dirty one gets as many tokens, and less than a block more.

    Too few dirty tokens are made up by clean blocks; of too many, a random part is kept.
    """
    clean, dirty = settle(clean), settle(dirty)  # made once, read for the sums and for the blocks
    n_clean, n_dirty = _tokens(clean), _tokens(dirty)
    if n_dirty < n_clean:
        more = _take(clean, n_clean - n_dirty, seed, key)
        dirty_side = dirty.withColumn("origin", F.lit("dirty")).unionByName(more.withColumn("origin", F.lit("clean")))
    elif n_clean < n_dirty:
        dirty_side = _take(dirty, n_clean, seed, key).withColumn("origin", F.lit("dirty"))
    else:
        dirty_side = dirty.withColumn("origin", F.lit("dirty"))
    return clean.withColumns({"origin": F.lit("clean"), "side": F.lit("clean")}).unionByName(dirty_side.withColumn("side", F.lit("dirty")))


def inject(blocks: DataFrame, pool: DataFrame, proportion: float, seed: int = 42, key: str = "block_id") -> DataFrame:
    """block order, origin (kept or injected), source id: int(n * proportion) random blocks replaced by the pool's.

    A short pool is used in rounds, the remainder of a round in its random order.
    """
    if not 0 <= proportion <= 1:
        raise ValueError("proportion lies between 0 and 1")
    blocks, pool = settle(blocks), settle(pool)
    n, n_pool = blocks.count(), pool.count()
    k = int(n * proportion)
    if k and not n_pool:
        raise ValueError("the pool is empty")
    kept = rank_by_hash(blocks, key, seed, "_r").where(F.col("_r") >= k).drop("_r").withColumns({"origin": F.lit("kept"), "copy": F.lit(0).cast("long")})
    ranked = rank_by_hash(pool, key, seed + 1, "_r")
    rounds = F.when(F.col("_r") < F.lit(k % n_pool if n_pool else 0), F.lit(k // n_pool + 1 if n_pool else 0)).otherwise(F.lit(k // n_pool if n_pool else 0))
    added = ranked.withColumn("copy", F.explode(F.when(rounds > 0, F.sequence(F.lit(0).cast("long"), (rounds - 1).cast("long"))).otherwise(F.array().cast("array<bigint>")))).drop("_r").withColumn("origin", F.lit("injected"))
    return kept.unionByName(added)


@dataclass(frozen=True)
class Targets:
    """Blocks of each side and of their pools."""

    clean: int
    dirty: int
    clean_pool: int
    dirty_pool: int


def targets(total_tokens: int, rate: float, size: int = 512, clean_pool: float = 1.0, dirty_pool: float = 1.0) -> Targets:
    """Half-even rounding; a rate above 0 asks for a dirty block at least, one below 1 for a clean one."""
    if total_tokens <= 0 or total_tokens % size:
        raise ValueError("total_tokens is a positive multiple of the block size")
    if not 0 <= rate <= 1:
        raise ValueError("the rate lies between 0 and 1")
    if clean_pool < 1 or dirty_pool < 1:
        raise ValueError("pool multipliers are 1 or more")
    blocks = total_tokens // size
    dirty = round(blocks * rate)
    if rate > 0:
        dirty = max(1, dirty)
    if rate < 1:
        dirty = min(blocks - 1, dirty)
    clean = blocks - dirty
    return Targets(clean, dirty, max(round(clean * clean_pool), clean), max(round(dirty * dirty_pool), dirty))


def head(blocks: DataFrame, n: int, key: str = "block_id") -> DataFrame:
    """The first n blocks by number."""
    return blocks.where(F.col(key) < n)


def mix(clean: DataFrame, dirty: DataFrame, total_tokens: int, rate: float, size: int = 512) -> DataFrame:
    """side and blocks: the heads of both pools at a rate. ValueError if a pool is too short."""
    want = targets(total_tokens, rate, size)
    clean, dirty = settle(clean), settle(dirty)
    for name, pool, n in (("clean", clean, want.clean), ("dirty", dirty, want.dirty)):
        there = pool.count()
        if there < n:
            raise ValueError(f"the {name} pool has {there} blocks, {n} are needed")
    return head(clean, want.clean).withColumn("side", F.lit("clean")).unionByName(head(dirty, want.dirty).withColumn("side", F.lit("dirty")))


def with_quotas(rows: DataFrame, clean: Column, dirty: Column, n_tokens: Column, want: Targets, size: int, key: str = "doc_id") -> DataFrame:
    """rows with clean_kept, dirty_kept and stop: what a single pass in the order of key takes.

    A side takes candidates while its tokens before the row are below its pool; the pass ends with the row after which
    both sides have theirs (stop: its key; null if the rows end first), and rows up to it count as seen.
    """
    rows = settle(rows.withColumns({"_n": n_tokens.cast("long"), "_c": clean, "_d": dirty}))
    rows = running_totals(rows, id_bucket(key), [key], {f"_b{s}": F.when(F.col(f"_{s}"), F.col("_n")).otherwise(F.lit(0).cast("long")) for s in "cd"})
    quota = {"c": want.clean_pool * size, "d": want.dirty_pool * size}
    reached = [F.min(F.when(F.col(f"_b{s}") + F.when(F.col(f"_{s}"), F.col("_n")).otherwise(0) >= q, F.col(key))) if q else F.lit(-1).cast("long") for s, q in quota.items()]
    ends = rows.agg(reached[0].alias("c"), reached[1].alias("d")).select(F.when(F.col("c").isNotNull() & F.col("d").isNotNull(), F.greatest("c", "d")).alias("stop"))
    seen = F.col("stop").isNull() | (F.col(key) <= F.col("stop"))
    out = rows.join(F.broadcast(ends))  # one row
    kept = {f"{name}_kept": F.col(f"_{s}") & (F.col(f"_b{s}") < quota[s]) & seen for s, name in (("c", "clean"), ("d", "dirty"))}
    return out.withColumns(kept | {"seen": seen}).drop("_n", "_c", "_d", "_bc", "_bd")


def build(annotated: DataFrame, tokenizer: Tokenizer, clean: Column, dirty: Column, want: Targets, size: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """side and blocks of the one-pass builder: quotas, packing, and the heads of the pools."""
    tokens = tokenize(annotated, tokenizer, key, text).select(key, "input_ids")
    flagged = annotated.select(key, clean.alias("is_clean_candidate"), dirty.alias("is_dirty_candidate")).join(tokens, key)
    taken = with_quotas(flagged, F.col("is_clean_candidate"), F.col("is_dirty_candidate"), F.size("input_ids"), want, size, key)
    sides = [head(pack(taken.where(f"{s}_kept"), size, key), n).withColumn("side", F.lit(s)) for s, n in (("clean", want.clean), ("dirty", want.dirty))]
    return sides[0].unionByName(sides[1])
