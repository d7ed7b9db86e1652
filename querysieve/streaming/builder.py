"""The one-pass builder over a stream: quotas, packing and audit counters, restartable after any batch.

Each micro-batch reads the state that the batch before it wrote, writes its blocks to a folder of its own and then its
state. A batch that is run again overwrites both, so a lost driver costs the batch it was at. The state is one row: what
each side has taken, the tokens short of a block, and the counters. Ids grow along the stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.functions import detect
from querysieve.operators import audit, balance, sample, tokens
from querysieve.operators.order import id_bucket, running_total, running_totals
from querysieve.sources import io

SIDES = ("clean", "dirty")
COUNTERS = ("n_total", "n_dirty", "n_clean", "keyword_only", "regex_only", "keyword_plus_regex", "keyword_only_ambiguous", "dirty_query", "dirty_non_query", "clean_leakage")
STATE = "batch long, done boolean, " + ", ".join(f"{s}_tokens long, {s}_blocks long, {s}_left array<int>, {s}_docs long" for s in SIDES) + ", " + ", ".join(f"{c} long" for c in COUNTERS)


@dataclass(frozen=True)
class Builder:
    """Where results go, what is taken and how much of it."""

    out: str
    want: balance.Targets
    tokenizer: tokens.Tokenizer = tokens.WordTokenizer()
    size: int = 512
    mode: str = "regex"
    exclude_strict: bool = False
    sample_size: int = 400
    key: str = "doc_id"
    #: Documents that are looked at, at most.
    most: int | None = None

    def quota(self, side: str) -> int:
        return (self.want.clean_pool if side == "clean" else self.want.dirty_pool) * self.size

    def state(self, spark: SparkSession, before: int | None = None) -> dict:
        """The last state (of a batch below `before`)."""
        empty = {"batch": -1, "done": False} | {f"{s}_{x}": 0 for s in SIDES for x in ("tokens", "blocks", "docs")} | {f"{s}_left": [] for s in SIDES} | dict.fromkeys(COUNTERS, 0)
        if not self._any(spark):
            return empty
        rows = spark.read.schema(STATE).json(f"{self.out}/state/*")
        row = (rows.where(F.col("batch") < before) if before is not None else rows).orderBy(F.desc("batch")).limit(1).collect()
        return row[0].asDict() if row else empty

    def _any(self, spark: SparkSession) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.out}/state")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch."""
        spark = batch.sparkSession
        old = self.state(spark, number)
        if old["done"]:
            return
        if self.most is not None:
            batch = running_total(batch, id_bucket(self.key), [self.key], F.lit(1).cast("long"), "_rank").where(F.col("_rank") < self.most - old["n_total"]).drop("_rank")
        rows = detect.annotate(batch).withColumn("_ids", self.tokenizer.ids(F.col("text"))).withColumn("_n", F.size("_ids").cast("long"))
        rows = rows.withColumns({"_clean": detect.clean_side(self.exclude_strict), "_dirty": detect.dirty_by(self.mode)}).persist()
        try:
            self._take(rows, number, old)
        finally:
            rows.unpersist()

    def _take(self, rows: DataFrame, number: int, old: dict) -> None:
        spark, key = rows.sparkSession, self.key
        placed = running_totals(rows, id_bucket(key), [key], {f"_b{s}": F.when(F.col(f"_{s}"), F.col("_n")).otherwise(F.lit(0).cast("long")) for s in SIDES})
        placed = placed.withColumns({f"_b{s}": F.col(f"_b{s}") + old[f"{s}_tokens"] for s in SIDES})
        reach = []
        for s in SIDES:
            after = F.col(f"_b{s}") + F.when(F.col(f"_{s}"), F.col("_n")).otherwise(F.lit(0))
            reach.append(F.lit(-1).cast("long") if old[f"{s}_tokens"] >= self.quota(s) else F.min(F.when(after >= self.quota(s), F.col(key))))
        a, b = placed.agg(reach[0].alias("a"), reach[1].alias("b")).first()
        stop = max(a, b) if a is not None and b is not None else None
        seen = placed if stop is None else placed.where(F.col(key) <= stop)
        new = {"batch": number, "done": stop is not None}
        for s in SIDES:
            taken = seen.where(F.col(f"_{s}") & (F.col(f"_b{s}") < self.quota(s))).select(key, F.col("_ids").alias("input_ids"))
            left = spark.createDataFrame([(-1, old[f"{s}_left"])], f"{key} long, input_ids array<int>")
            blocks = tokens.pack_all(left.unionByName(taken), self.size, key).persist()
            full = blocks.where(F.size("input_ids") == self.size)
            first = old[f"{s}_blocks"]
            io.write_parquet(full.select((F.col("block_id") + first).alias("block_id"), "input_ids", "attention_mask"), f"{self.out}/blocks/{s}/chunk_{number:06d}", overwrite=True)
            tail = blocks.where(F.size("input_ids") < self.size).select("input_ids").collect()  # less than one block
            n_docs, n_tokens = taken.agg(F.count("*"), F.coalesce(F.sum(F.size("input_ids").cast("long")), F.lit(0))).first()
            new |= {f"{s}_tokens": old[f"{s}_tokens"] + n_tokens, f"{s}_blocks": first + full.count(), f"{s}_docs": old[f"{s}_docs"] + n_docs, f"{s}_left": list(tail[0][0]) if tail else []}
            blocks.unpersist()
        counted = audit.totals(seen).first().asDict()
        new |= {c: old[c] + counted[c] for c in COUNTERS}
        new["done"] |= self.most is not None and new["n_total"] >= self.most
        audit.samples(seen, self.sample_size, "first_k", key=key).write.mode("overwrite").json(f"{self.out}/samples/batch_{number:06d}")
        spark.createDataFrame([tuple(new[f.split()[0]] for f in STATE.split(", "))], STATE).coalesce(1).write.mode("overwrite").json(f"{self.out}/state/batch_{number:06d}")

    def run(self, stream: DataFrame) -> None:
        """Takes what the stream has, from where the last run ended."""
        stream.writeStream.foreachBatch(lambda df, n: self.take(df, n)).option("checkpointLocation", f"{self.out}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def blocks(self, spark: SparkSession, side: str, final: bool = True) -> DataFrame:
        """Blocks of a side's pool, or those of its target."""
        pool = spark.read.option("recursiveFileLookup", True).schema("block_id long, input_ids array<int>, attention_mask array<int>").parquet(f"{self.out}/blocks/{side}")
        return balance.head(pool, self.want.clean if side == "clean" else self.want.dirty) if final else pool

    def samples(self, spark: SparkSession) -> DataFrame:
        """The first records of each category over all batches."""
        rows = spark.read.option("recursiveFileLookup", True).json(f"{self.out}/samples").drop("rank")
        return sample.first_k(rows, self.sample_size, "category", "index")


def running_counts(stream: DataFrame) -> DataFrame:
    """Documents by trigger, kept up to date over a stream."""
    return detect.annotate(stream).groupBy(detect.trigger().alias("trigger")).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """A stream's rows, each combination of keys once; all keys seen are state."""
    return stream.dropDuplicates(keys)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by type and window of event time; later ones than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
