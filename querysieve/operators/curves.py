"""Perplexity series of a training log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import id_bucket


def log_rows(state: DataFrame) -> DataFrame:
    """step, loss, eval_loss of a trainer's state."""
    return state.select(F.explode("log_history").alias("e")).select("e.step", "e.loss", "e.eval_loss")


def evaluations(log: DataFrame, steps_per_epoch: int, run: str | None = None) -> DataFrame:
    """epoch, perplexity and their changes from one evaluation to the next, of each run.

    Evaluations are ordered inside buckets of steps; the first of a bucket follows the last of the bucket before it.
    """
    runs = [run] if run else []
    rows = log.where(F.col("eval_loss").isNotNull()).withColumns({"epoch": F.col("step") / F.lit(steps_per_epoch), "perplexity": F.exp("eval_loss"), "_bucket": id_bucket("step")})
    w = W.partitionBy(*runs, "_bucket").orderBy("epoch")
    here = F.struct("epoch", "perplexity")
    lasts = rows.groupBy(*runs, "_bucket").agg(F.max(here).alias("_last"))
    across = W.partitionBy(*runs).orderBy("_bucket") if runs else W.orderBy("_bucket")  # one row a bucket
    lasts = lasts.select(*runs, "_bucket", F.lag("_last").over(across).alias("_carried"))
    rows = rows.withColumn("_prev", F.lag(here).over(w)).join(lasts, [*runs, "_bucket"]).withColumn("_prev", F.coalesce("_prev", "_carried"))
    rows = rows.withColumns({"epoch_delta": F.col("epoch") - F.col("_prev.epoch"), "ppl_prev": F.col("_prev.perplexity")})
    gain = F.when(F.col("ppl_prev") != 0, 100 * (F.col("ppl_prev") - F.col("perplexity")) / F.col("ppl_prev"))
    rows = rows.withColumn("ppl_rel_improv_pct", gain)
    per_epoch = F.when(F.col("epoch_delta") != 0, F.col("ppl_rel_improv_pct") / F.col("epoch_delta"))
    figures = ["epoch", "perplexity", "epoch_delta", "ppl_prev", "ppl_rel_improv_pct"]
    return rows.select(*([run] if run else []), "step", *[F.round(c, 4).alias(c) for c in figures], F.round(per_epoch, 4).alias("ppl_improv_pct_per_epoch"))


def training(log: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Training losses as a series."""
    return log.where(F.col("loss").isNotNull()).select("step", F.round(F.col("step") / F.lit(steps_per_epoch), 4).alias("epoch"), F.round(F.exp("loss"), 4).alias("perplexity"))
