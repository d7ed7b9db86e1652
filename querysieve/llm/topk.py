"""Exact top-k inner products by pivot-table elimination.

The pivot table holds each row's distances to many pivots (and to the origin: its norm). Together they fix where the
row's projection lies in the space that the pivots span, and how far above that space the row stands, so
d(q, x)^2 >= |q' - x'|^2 + (h(q) - h(x))^2 for projections q', x' and heights h. It is the largest lower bound that these
distances allow: no pivot's triangle inequality, nor any set of them, gives a larger one. As
2<q, x> = |q|^2 + |x|^2 - d(q, x)^2, it bounds the product from above. Each query evaluates its candidates in the order of
their bounds and stops when the next bound is below its k-th best product: what is left can't enter the result, ties
included, so the result is exact. Pivots are taken farthest first: each is the row of a bounded sample that stands
highest above the space of those before.

Queries come in blocks, which every task gets; rows stay where they are, and each task keeps k rows for each query.
Blocks are worked on in waves of WAVE, each one job. The rows are never paired with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices

K = 20
#: Pivots as a share of the vectors' length, and the rows that they are chosen from.
PIVOTS, SAMPLED = 0.875, 4096
#: Queries in one block, blocks in one job, rows that bounds are worked out for at a time, and candidates evaluated at a time.
BLOCK, WAVE, ROWS, CHUNK = 8192, 8, 2048, 64


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)


class PivotTable:
    """Pivots of one length, and what their distances say of rows."""

    def __init__(self, sample: np.ndarray, pivots: int):
        rest, norms = sample.copy(), (sample * sample).sum(1)
        chosen: list[int] = []
        height = norms.copy()
        while len(chosen) < min(pivots, len(sample)) and (best := int(height.argmax())) >= 0 and height[best] > 1e-6 * max(1.0, norms.max()):
            chosen.append(best)
            axis = rest[best] / np.sqrt(height[best])
            rest -= np.outer(rest @ axis, axis)
            height = (rest * rest).sum(1)
        self.points = sample[chosen]
        self.norms = (self.points * self.points).sum(1)
        self.solve = np.linalg.inv(np.linalg.cholesky(self.points @ self.points.T)).T if chosen else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return (x * x).sum(1)[:, None] + self.norms[None] - 2 * (x @ self.points.T)

    def places(self, x: np.ndarray) -> np.ndarray:
        """From a row's distances to the pivots and the origin: its projection in the pivots' space, and its height above."""
        norm = (x * x).sum(1)
        at = (norm[:, None] + self.norms[None] - self.distances(x)) / 2 @ self.solve
        return np.concatenate([at, np.sqrt(np.maximum(0.0, norm - (at * at).sum(1)))[:, None]], axis=1)


def best(table: PivotTable, queries: np.ndarray, q_ids: np.ndarray, q_at: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray]) -> int:
    """Enters rows into held, the k best (products, ids) of each query, and says how many products were evaluated.

    Products are whole numbers; ties go to smaller ids. held starts as -inf, with the largest id.
    """
    products, owners = held
    evaluated = 0
    for a in range(0, len(rows), ROWS):
        part, names = rows[a : a + ROWS], ids[a : a + ROWS]
        at = table.places(part)
        # rounding may lower a bound by some parts in 1e7 (heights are roots of differences); the margin keeps it one
        bounds = q_at @ at.T + (0.5 + 1e-6 * np.sqrt((queries * queries).sum(1))[:, None] * np.sqrt((part * part).sum(1))[None])
        for i in np.flatnonzero(bounds.max(axis=1) >= products[:, -1]):
            bound = bounds[i]
            may = np.flatnonzero(bound >= products[i, -1])
            may = may[np.argsort(-bound[may], kind="stable")]
            for z in range(0, len(may), CHUNK):
                some = may[z : z + CHUNK]
                if bound[some[0]] < products[i, -1]:
                    break
                some = some[names[some] != q_ids[i]]
                evaluated += len(some)
                score = np.rint(part[some] @ queries[i])
                good = score >= products[i, -1]
                if good.any():
                    s, w = np.concatenate([products[i], score[good]]), np.concatenate([owners[i], names[some[good]]])
                    order = np.lexsort((w, -s))[:k]
                    products[i], owners[i] = s[order], w[order]
    return evaluated


def search(rows: DataFrame, queries: Column, vector: Column, key: str = "vec_id", k: int = K, pivots: float = PIVOTS, block: int = BLOCK, counted=None) -> DataFrame:
    """query_id, rank, key, score: for each row that the condition queries picks, the k best other rows.

    vector: ARRAY<DOUBLE> of whole numbers; products up to 2^53 are exact. Rows whose vector is null, empty or holds a null
    or non-finite number take no part, nor do rows without a key. Vectors of different lengths have no product: a query is
    compared with those of its own length. Rows of a query's own key are left out. A row that stands twice takes two
    ranks; as a query it counts once. An empty table gives an empty result. counted: an accumulator for the number of products evaluated.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col(key).cast("long").alias("id"), vector.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    usable = usable.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("v") > 0))
    asked = cut(usable.where("q").select("id", "v").dropDuplicates())
    n = asked.count()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score long")
    # lengths have the pivots of the sampled rows that have it: the most frequent ones the most, a rare one none (then norms bound)
    drawn = usable.orderBy(F.xxhash64("id")).limit(SAMPLED).toPandas()["v"]
    tables = {int(m): PivotTable(np.stack(vs.to_numpy()).astype(np.float64), max(1, int(pivots * m))) for m, vs in drawn.groupby(drawn.map(len))}
    blocks = -(-n // block)

    def found(j: int) -> DataFrame | None:
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == j)).toPandas()
        by_length = {}
        for m, some in own.groupby(own["v"].map(len)):
            q = np.stack(some["v"].to_numpy()).astype(np.float64)
            table = tables.get(int(m)) or PivotTable(np.zeros((0, int(m))), 0)
            by_length[int(m)] = table, q, some["id"].to_numpy(np.int64), table.places(q)
        if not by_length:
            return None
        shared = spark.sparkContext.broadcast(by_length)

        def run(batches):
            held = {m: (np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)) for m, (_, q, _, _) in shared.value.items()}
            for b in slices(batches, 4 * ROWS):
                sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for m in np.unique(sizes).tolist():
                    if m in held:
                        own = b if (sizes == m).all() else b.filter(pa.array(sizes == m))
                        table, q, q_ids, q_at = shared.value[m]
                        evaluated = best(table, q, q_ids, q_at, matrix(own.column(1), m), own.column(0).to_numpy(), k, held[m])
                        if counted is not None:
                            counted.add(evaluated)
            for m, (products, owners) in held.items():
                i, r = np.nonzero(products > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[m][2][i]), pa.array(owners[i, r]), pa.array(products[i, r].astype(np.int64))], ["query_id", "id", "score"])

        return usable.select("id", "v").mapInArrow(run, "query_id long, id long, score long")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    waves = []
    for at in range(0, blocks, WAVE):
        parts = [df for j in range(at, min(blocks, at + WAVE)) if (df := found(j)) is not None]
        if parts:
            both = parts[0]
            for df in parts[1:]:
                both = both.unionByName(df)
            both = both.select("query_id", rank.alias("rank"), F.col("id").alias(key), "score").where(F.col("rank") <= k)
            waves.append(cut(both) if blocks > WAVE else both)
    out = waves[0]
    for df in waves[1:]:
        out = out.unionByName(df)
    return out


def sixty_fourths(embedding: str = "embedding") -> Column:
    """Components in whole 64ths; null for a vector with a null or non-finite one, which floor would make a number."""
    v = F.col(embedding).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x * 64).cast("double")))
