"""Benchmark decontamination by winnowing.

Every item's words are cut into windows of SPAN words (a shorter item is one window). A window's fingerprint is the
least hash of the K-word runs in it, so a text and an item that share SPAN words in a row share the fingerprint of
that window, wherever it stands. Items' fingerprints form a table; a document's windows are looked up in it, and a
hit is extended to the whole window by comparing its words, which leaves exact hits only. Overlapping hits join.

The table of a benchmark of at most BLOCK bytes of text goes to every task. The windows of a larger one are a table of
their own: a bounded filter of its fingerprints tells which windows of the documents may be hits, and those are joined with it
by 128 bits of their words' hashes. The documents are written out once, with row numbers, and get their hits by these.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gram_hashes, hash_words, mix, raw_bytes, slices

SPAN, K = 8, 4
#: UTF-8 bytes of benchmark text that every task may be sent; slots of the filter of a larger one's fingerprints.
BLOCK, SLOTS = 16 << 20, 1 << 26

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(raw: bytes | None) -> list[bytes]:
    return WORD.findall(raw.lower()) if raw else []


class Windows:
    """Windows of benchmark items: their fingerprints, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN, k: int = K):
        self.span, self.k = span, k
        self.number: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = {}
        prints, self.short = [], {}
        for name, raw in items:
            own = words(raw)
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in own], np.uint32)
            if len(ids) >= span:
                for i in range(len(ids) - span + 1):
                    self.items.setdefault(ids[i : i + span].tobytes(), set()).add(name)
                prints.append(self.fingerprints(ids))
            elif len(ids):
                self.items.setdefault(ids.tobytes(), set()).add(name)
                self.short.setdefault(len(ids), []).append(self.runs(ids, len(ids)))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.short = {n: np.unique(np.concatenate(v)) for n, v in self.short.items()}

    @staticmethod
    def runs(ids: np.ndarray, k: int) -> np.ndarray:
        """Hashes of runs of k words; the greatest number where one of them is in no item."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out, known = np.full(n, k, np.uint64), np.ones(n, bool)
        for i in range(k):
            w = ids[i : i + n]
            out = out * np.uint64(0x9E3779B97F4A7C15) + w
            known &= w > 0
        return np.where(known, mix(out), _NONE)

    def fingerprints(self, ids: np.ndarray) -> np.ndarray:
        """Of each window, in order of position."""
        h = self.runs(ids, self.k)
        n = len(ids) - self.span + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = h[:n]
        for i in range(1, self.span - self.k + 1):
            out = np.minimum(out, h[i : i + n])
        return out

    @staticmethod
    def _in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(table) or not len(values):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return np.flatnonzero((table[at] == values) & (values != _NONE))

    def search(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans (start, end) in words, items found."""
        own = words(raw)
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in own), np.uint32, len(own))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for n, at in [(self.span, self._in(self.prints, self.fingerprints(ids))), *((n, self._in(t, self.runs(ids, n))) for n, t in self.short.items())]:
            for i in at.tolist():
                items = self.items.get(ids[i : i + n].tobytes())
                if items:
                    found |= items
                    spans.append((i, i + n))
        return len(own), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = out[-1][0], max(j, out[-1][1])
        else:
            out.append((i, j))
    return out


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block: int = BLOCK, added: tuple[str, str, str] = ("n_words", "hits", "items")) -> DataFrame:
    """docs with n_words, hits ARRAY<STRUCT<start, end>> (word positions, end exclusive) and items ARRAY<STRING>, sorted.

    added: their names; columns of docs that have these are replaced. A null or wordless text has no hits; items without id or words have no windows. Rows are not matched by any key,
    so repeated documents and ids are searched one by one.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("t"))
    if items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] > block:
        return _joined(docs, items, text, span, k, added)
    fields = [c for c in docs.columns if c not in added]
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in fields) + f", `{added[0]}` long, `{added[1]}` array<struct<start:int,end:int>>, `{added[2]}` array<string>"
    shared = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in items.select("item", F.col("t").cast("binary")).collect()])  # at most block bytes

    def run(batches):
        index = Windows(shared.value, span, k)
        for b in slices(batches, 1000):
            rows = [index.search(raw) for raw in raw_bytes(b.column(text))]
            found = [pa.array([r[0] for r in rows], pa.int64()), _hits([r[1] for r in rows]), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), *found], [*fields, *added])

    return docs.select(*fields).mapInArrow(run, schema)


def _hits(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": i, "end": j} for i, j in own] for own in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _prints(h: np.ndarray, span: int, k: int) -> np.ndarray:
    """Fingerprints of the windows of a text by its words' hashes."""
    runs = gram_hashes(h, k)
    return np.lib.stride_tricks.sliding_window_view(runs, span - k + 1).min(axis=1) if len(h) >= span else np.empty(0, np.uint64)


def _named(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the hash of each run of n words."""
    return gram_hashes(h, n).view(np.int64), gram_hashes(mix(h + np.uint64(1)), n).view(np.int64)


def _joined(docs: DataFrame, items: DataFrame, text: str, span: int, k: int, added: tuple[str, str, str]) -> DataFrame:
    """As search, by a join with the windows of a large benchmark."""
    spark = docs.sparkSession
    names = ["item", "n", "a", "b", "print"]

    def windows(batches):
        for b in slices(batches, 1000):
            out: list[list] = [[], [], [], [], []]
            for name, raw in zip(b.column(0).to_pylist(), raw_bytes(b.column(1))):
                h = hash_words(words(raw))
                n = min(span, len(h))
                if n:
                    x, y = _named(h, n)
                    print_ = _prints(h, span, k).view(np.int64) if n == span else x
                    for column, value in zip(out, (pa.array([name] * len(x), pa.string()), np.full(len(x), n, np.int32), x, y, print_)):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[0]), *(pa.array(np.concatenate(c)) for c in out[1:])], names)

    table = cut(items.mapInArrow(windows, "item string, n int, a long, b long, print long").distinct())
    slot = F.pmod("print", F.lit(SLOTS))
    bits = table.groupBy("n", F.shiftright(slot, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(print, {SLOTS}) & 63 as int)))").alias("bits")).toPandas()  # at most span * SLOTS / 64 rows
    filters = {}
    for n, own in bits.groupby("n"):
        filters[int(n)] = np.zeros(SLOTS // 64, np.int64)
        filters[int(n)][own["w"].to_numpy(np.int64)] = own["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(filters)
    fields = [c for c in docs.columns if c not in added]
    rows = cut(docs.select(F.struct(*fields).alias("r"), F.col(text).alias("x"), F.monotonically_increasing_id().alias("row")))

    def looked_up(batches):
        """Windows that the filter lets pass, and each row's number of words (n = 0)."""
        for b in slices(batches, 1000):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for row, raw in zip(b.column(1).to_pylist(), raw_bytes(b.column(0))):
                h = hash_words(words(raw))
                for n, own in shared.value.items():
                    x, y = _named(h, n)
                    s = (_prints(h, span, k).view(np.int64) if n == span else x) % SLOTS
                    at = np.flatnonzero(own[s >> 6] >> (s & 63) & 1)
                    for column, value in zip(out, (np.full(len(at), row), np.full(len(at), n, np.int32), at.astype(np.int64), x[at], y[at])):
                        column.append(value)
                for column, value in zip(out, ([row], np.zeros(1, np.int32), [len(h)], [0], [0])):
                    column.append(np.asarray(value))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["row", "n", "pos", "a", "b"])

    found = cut(rows.select("x", "row").mapInArrow(looked_up, "row long, n int, pos long, a long, b long"))
    named = table.groupBy("n", "a", "b").agg(F.collect_set("item").alias("items"))
    hits = found.where("n > 0").join(named, ["n", "a", "b"]).groupBy("row").agg(F.collect_list(F.struct("pos", "n")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def joined(batches):
        for b in slices(batches, 1000):
            yield pa.RecordBatch.from_arrays([b.column(0), _hits([merged([(x["pos"], x["pos"] + x["n"]) for x in own]) for own in b.column(1).to_pylist()]), b.column(2)], ["row", "hits", "items"])

    hits = hits.mapInArrow(joined, "row long, hits array<struct<start:int,end:int>>, items array<string>")
    both = rows.join(found.where("n = 0").select("row", F.col("pos").alias("n_words")), "row").join(hits, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    return both.select(*[F.col("r")[c].alias(c) for c in fields], F.col("n_words").alias(added[0]), F.coalesce("hits", none[0]).alias(added[1]), F.coalesce("items", none[1]).alias(added[2]))


def report(docs: DataFrame, benchmark: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least `least` items)."""
    found = search(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["end"] - h["start"]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("items") >= least).alias("contaminated"),
    )
