"""Sharding by sampled splitters, in DataFrame operations only.

1. Every row gets a size and a position: the hash of its group (equal texts) and, below that, of its id.
2. A size-weighted sample of positions, of bounded expected size, is drawn by hash; its quantiles are splitters that
   cut the positions into many narrow ranges.
3. The exact bytes of each range are summed. Ranges that hold more than their share (a frequent text sits at one
   position) are subdivided by id hash, in as many parts as their bytes ask for.
4. A running sum over the ranges gives every range its place; the running sum inside a range gives each row its
   place, and the place its shard. Groups in ranges that were not subdivided stay together; larger ones are spread.

Law: ``bytes``. Shard sizes differ by less than two narrow ranges plus a row. Only (id, size, hash) move; no text does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Narrow ranges a shard is made of, and sampled positions a range.
RANGES, DRAWN = 256, 8


def _range_of(df: DataFrame, splitters: list[int], into: str) -> DataFrame:
    """df with the number of splitters that are <= _at.

    Positions are hashes, so their top 12 bits deal the splitters out evenly: a constant table has the few splitters
    of each of the 4096 cells, and the number of those in earlier cells.
    """
    by: dict[int, list[int]] = {}
    for x in splitters:
        by.setdefault(x >> 52, []).append(x)
    table, before = [], 0
    for cell in range(-2048, 2048):
        table.append((cell, before, by.get(cell, [])))
        before += len(by.get(cell, []))
    cells = df.sparkSession.createDataFrame(table, "_cell int, _before int, _own array<long>")
    found = df.withColumn("_cell", F.shiftright("_at", 52).cast("int")).join(F.broadcast(cells), "_cell")
    inside = F.size(F.filter("_own", lambda x: x <= F.col("_at")))
    return found.withColumn(into, F.col("_before") + inside).drop("_cell", "_before", "_own")


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (null) of every row.

    size: UTF-8 bytes of the text plus 1; a null text has no bytes and the crc32 of none. Rows of equal key are told
    apart by nothing, and share out the slots of their position; those without a key are spread like any others. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = cut(rows.select("*", F.xxhash64("text_crc32", "size").alias("_at"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.monotonically_increasing_id()))).alias("_sub")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    fine = shards * ranges
    share = total / fine
    if not total:
        return rows.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # one draw for each share/DRAWN bytes: a row of that many bytes or more is always drawn, and weighs as many draws
    unit = max(1.0, share / DRAWN)
    luck = F.pmod(F.xxhash64(F.lit("draw"), "_sub", "_at"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select("_at", F.floor(F.col("size") / unit + luck).alias("n")).where("n > 0").groupBy("_at").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(W.orderBy("_at"))  # of the sample: at most fine * DRAWN draws are expected
    chosen = drawn.select("_at", "n", running.alias("upto")).where(F.floor(F.col("upto") / DRAWN) > F.floor((F.col("upto") - F.col("n")) / DRAWN))
    splitters = sorted(r[0] for r in chosen.select("_at").collect())
    placed = _range_of(rows, splitters, "_range")
    held = placed.groupBy("_range").agg(F.sum("size").alias("bytes"))
    over = F.greatest(F.lit(1), F.ceil(F.col("bytes") / (2 * share))).cast("int")
    parts = {r[0]: r[1] for r in held.select("_range", over.alias("parts")).where("parts > 1").collect()}  # fewer than fine
    if parts:
        known = docs.sparkSession.createDataFrame(list(parts.items()), "_range int, _part int")
        placed = placed.join(F.broadcast(known), "_range", "left").withColumn("_part", F.coalesce("_part", F.lit(1))).withColumn("_split", F.col("_part") > 1)
        placed = placed.withColumn("_part", F.pmod(F.col("_sub"), F.col("_part")).cast("int"))
    else:
        placed = placed.withColumns({"_part": F.lit(0), "_split": F.lit(False)})
    sums = placed.groupBy("_range", "_part").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(W.orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("_range", "_part", F.coalesce(before, F.lit(0)).alias("_start"))  # fewer than 3 * fine rows
    inside = W.partitionBy("_range", "_part").orderBy("_at", "_sub", key)
    row_start = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_off", row_start).join(F.broadcast(starts), ["_range", "_part"])
    group = F.min("_off").over(W.partitionBy("_range", "_part", "_at"))
    place = F.col("_start") + F.when(F.col("_split"), F.col("_off")).otherwise(group)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(place * F.lit(shards) / F.lit(total))).cast("int"))
    # slots: places among the rows of the same shard in the same range part, after those of earlier parts
    counts = placed.groupBy("shard", "_range", "_part").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("_range", "_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("shard", "_range", "_part", first.alias("_first"))
    nth = F.row_number().over(W.partitionBy("_range", "_part", "shard").orderBy("_at", "_sub", key))
    return (
        placed.withColumn("_nth", nth)
        .join(F.broadcast(firsts), ["shard", "_range", "_part"])
        .select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
