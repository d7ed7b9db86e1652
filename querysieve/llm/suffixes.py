"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at positions that the text itself selects: the least hash of the runs of GRAM words in every
window of runs (minimisers). Equal passages select equal positions, and every passage of `passage` words has one
among its first words from which half of it, its key, lies inside it. Suffixes are dealt by the hash of those words and sorted
by content; neighbours are compared to the right, and matches extended to the left: for each number of words to the left, the
suffixes that agree on those are sorted by what follows, and where neighbours agree on enough to make up `passage` words, that span is
marked in both texts. As a suffix's best partner for a given extent to the left is its neighbour in that order, every word of every passage
that stands twice is found, and nothing else. A text's spans are united, so a longer passage is covered by the spans of its several suffixes.

Texts are named by 64 bits of a digest, so copies of a text are one text; they are marked in whole. Only suffixes whose key
occurs twice are sorted: a first pass counts the keys. The words around its position go with a suffix, as 32 bits of each
word's hash. Where a batch holds several suffixes with all those words alike, two represent them, and the others
get the spans of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, cut, gram_hashes, hash_words, map_arrow, mix, raw_bytes, slices

PASSAGE, GRAM = 50, 8
SLOTS = 1 << 26  # of the filter by key; bounds what is broadcast, decides no result
#: Documents packed together; suffixes of a bucket, and those of some keys (or one) that are sorted together.
PACK, PER_BUCKET, TOGETHER = 2000, 100_000, 30_000


class Measures:
    """For passages of n words: words of a key, runs in a window, words that go with a suffix to its left and right."""

    def __init__(self, n: int):
        self.passage, self.key = n, n // 2 - 1
        self.window = n - self.key + 1  # a passage of n words holds a selected position and its key
        self.left, self.right = n - self.key, n

    def anchors(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Selected positions that have a key's words after them, and their keys."""
        if len(h) < self.passage:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = gram_hashes(h, GRAM)
        least = np.lib.stride_tricks.sliding_window_view(grams, self.window).argmin(axis=1) + np.arange(len(grams) - self.window + 1)
        at = np.unique(least)
        at = at[at + self.key <= len(h)]
        return at, gram_hashes(h, self.key)[at]

    def contexts(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words to the left and from each position on, as 32-bit numbers; 0 beyond the text."""
        short = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))
        padded = np.concatenate([np.zeros(self.left, np.uint32), short, np.zeros(self.right, np.uint32)])
        return np.lib.stride_tricks.sliding_window_view(padded, self.left + self.right)[at]


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of leading equal columns, row by row."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def compare(keys: np.ndarray, texts: np.ndarray, pos: np.ndarray, ctx: np.ndarray, m: Measures) -> np.ndarray:
    """Passages that suffixes of equal keys share: suffix, words to its left, and the two least texts that have the passage (twice the same if it is only one)."""
    left, right = ctx[:, m.left - 1 :: -1], ctx[:, m.left :]
    order = np.argsort(keys, kind="stable")
    edge = _changes(keys[order])
    several = np.repeat(np.diff(np.append(edge, len(keys))) > 1, np.diff(np.append(edge, len(keys))))
    rows = order[several]
    rank = _ranks(np.concatenate([keys[rows].astype(">u8").view(np.uint8).reshape(len(rows), 8), np.ascontiguousarray(right[rows].astype(">u4")).view(np.uint8).reshape(len(rows), -1)], axis=1))
    _, group = np.unique(keys[rows], return_inverse=True)
    spans = []
    for l in range(m.left + 1):
        if l:  # those that agree on one more word to the left, which is in the text
            kept = left[rows, l - 1] > 0
            rows, rank, group = rows[kept], rank[kept], group[kept]
            _, group = np.unique(group.astype(np.uint64) << np.uint64(32) | left[rows, l - 1].astype(np.uint64), return_inverse=True)
            kept = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
            rows, rank, group = rows[kept], rank[kept], group[kept]
        if not len(rows):
            break
        order = np.lexsort((rank, group))
        a, b = rows[order[:-1]], rows[order[1:]]
        need = m.passage - l
        near = np.zeros(len(order), bool)  # of each in order, whether it agrees with the one before on the rest of a passage
        same = np.flatnonzero(group[order[:-1]] == group[order[1:]])
        near[1 + same] = (right[a[same], :need] == right[b[same], :need]).all(axis=1) & (right[a[same], need - 1] > 0)
        run = np.cumsum(~near) - 1
        sizes = np.bincount(run)
        inside = sizes[run] > 1
        own, run = rows[order][inside], run[inside]
        if len(own):
            # of each run the least text, and the least other one
            o = np.lexsort((pos[own], texts[own], run))
            own, run = own[o], run[o]
            first = _changes(run)
            sizes = np.diff(np.append(first, len(run)))
            least, last = texts[own[first]], texts[own[first + sizes - 1]]
            others = np.where(texts[own] == np.repeat(least, sizes), np.iinfo(np.int64).max, texts[own])
            second = np.where(least == last, least, np.minimum.reduceat(others, first))
            spans.append(np.stack([own, np.full(len(own), l), np.repeat(least, sizes), np.repeat(second, sizes)], axis=1))
    return np.concatenate(spans) if spans else np.empty((0, 4), np.int64)


def spans_of(texts: np.ndarray, pos: np.ndarray, shared: np.ndarray, m: Measures) -> np.ndarray:
    """Spans (text, start, end, other text) of shared passages (words to the left, least text, next one): overlapping ones with the same other as one."""
    if not len(texts):
        return np.empty((0, 4), np.int64)
    spans = np.stack([texts, pos - shared[:, 0], pos - shared[:, 0] + m.passage, np.where(texts == shared[:, 1], shared[:, 2], shared[:, 1])], axis=1)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 3], spans[:, 0]))]
    new = np.concatenate([[True], (spans[1:, [0, 3]] != spans[:-1, [0, 3]]).any(axis=1)])
    # spans are of one length here, so the one before reaches furthest
    new[1:] |= spans[1:, 1] >= spans[:-1, 2]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], spans[at, 1], np.maximum.reduceat(spans[:, 2], at), spans[at, 3]], axis=1)


def _changes(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _ranks(content: np.ndarray) -> np.ndarray:
    """Order numbers of byte rows: equal rows get equal numbers."""
    if not len(content):
        return np.empty(0, np.int64)
    rows = np.ascontiguousarray(content).view(f"S{content.shape[1]}").reshape(-1)
    order = np.argsort(rows, kind="stable")
    ranks = np.empty(len(rows), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], (rows[order][1:] != rows[order][:-1]).astype(np.int64)]))
    return ranks


def represented(keys: np.ndarray, texts: np.ndarray, pos: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes that agree on all words that go with them those beyond the two least, and the least of another text; and of each the least, which stands for it."""
    weight = mix(np.arange(1, ctx.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    alike = mix((ctx.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + keys)
    order = np.lexsort((pos, texts, alike))
    first = _changes(alike[order])
    of = np.repeat(first, np.diff(np.append(first, len(order))))
    another = texts[order] != texts[order[of]]
    nth = np.cumsum(another)
    gone = (np.arange(len(order)) - of >= 2) & ~(another & (nth - (nth - another)[of] == 1))
    return order[gone], order[of[gone]]


def parts_of(keys: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of sorted keys that hold most of them at most, or one key."""
    edges = np.append(_changes(keys), len(keys))
    out, i = [], 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + most, "right")) - 1)
        out.append((int(edges[i]), int(edges[j])))
        i = j
    return out


def place(texts: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A number for a text and a position."""
    return mix(mix(texts.view(np.uint64)) + pos.astype(np.uint64))


def united(spans: list[tuple[int, int, int]]) -> list[dict]:
    """Overlapping spans as one, each with the least other document that was met there."""
    out: list[list[int]] = []
    for i, j, other in sorted(spans):
        if out and i < out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
            out[-1][2] = min(out[-1][2], other)
        else:
            out.append([i, j, other])
    return [{"start": i, "end": j, "other": o} for i, j, o in out]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int = PASSAGE, within: bool = True) -> DataFrame:
    """key, n_words, n_repeated, others ARRAY<LONG>, spans ARRAY<STRUCT<start, end, other>> of documents with repeats.

    A word counts as repeated if a passage of `passage` words around it stands twice. Positions are in words of the text
    lower-cased (A-Z) and cut at ASCII white space. A passage that stands twice in one document and in no other counts
    unless within is false (other: the least key of that text). An other is the least key of the text that it names, or the greatest where that is the document itself
    and it has copies. Null, empty and short texts have none; rows with a null key are left out; a key with several texts
    has a row for each. Keys are whole numbers.
    """
    if passage < 2 * GRAM + 2:
        raise ValueError(f"a passage has {2 * GRAM + 2} words or more")
    m = Measures(passage)
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("x"))

    def count(batches):
        """Keys of each distinct text of a batch; one that a text has twice counts twice."""
        held, n = [], 0
        for b in slices(batches, PACK):
            found = [m.anchors(hash_words(ascii_words(x)))[1] for x in {*raw_bytes(b.column(1))}]
            held.append(np.concatenate(found))
            n += len(held[-1])
            if n > 1_000_000:
                yield _counted(held)
                held, n = [], 0
        if n:
            yield _counted(held)

    counts = rows.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1")
    slot = F.pmod("k", F.lit(SLOTS))
    words = counts.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(k, {SLOTS}) & 63 as int)))").alias("bits"), F.sum("n").alias("n"))
    words = words.toPandas()  # at most SLOTS / 64 rows
    expected = int(words["n"].sum()) if len(words) else 0
    filled = np.zeros(SLOTS // 64, np.int64)
    filled[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(filled)
    buckets = max(1, math.ceil(expected / PER_BUCKET))

    def pack(b):
        bits = shared.value
        names, keys, who, pos, ctx, seen = [], [], [], [], [], set()
        for x in raw_bytes(b.column(1)):
            own = ascii_words(x)
            if len(own) < passage or (name := named(own)) in seen:
                continue
            seen.add(name)
            h = hash_words(own)
            at, k = m.anchors(h)
            slot = k.view(np.int64) % SLOTS
            some = (bits[slot >> 6] >> (slot & 63)) & 1 == 1
            if some.any():
                at = at[some]
                keys.append(k[some])
                who.append(np.full(len(at), len(names)))
                names.append(name)
                pos.append(at)
                ctx.append(m.contexts(h, at))
        if not names:
            return None
        keys, texts, pos, ctx = np.concatenate(keys), np.array(names, np.int64)[np.concatenate(who)], np.concatenate(pos), np.concatenate(ctx)
        gone, by = represented(keys, texts, pos, ctx)
        bucket = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        followers = np.stack([texts[gone], pos[gone], place(texts[by], pos[by]).view(np.int64)], axis=1)
        follow = bucket[gone]
        stay = np.ones(len(keys), bool)
        stay[gone] = False
        order = np.flatnonzero(stay)[np.argsort(bucket[stay], kind="stable")]
        keys, texts, pos, ctx, bucket = keys[order], texts[order], pos[order], ctx[order], bucket[order]
        some = np.unique(bucket)  # those of the followers are among them
        lo, hi = np.searchsorted(bucket, some), np.searchsorted(bucket, some, "right")

        def each(f):
            return pa.array([f(slice(i, j)).tobytes() for i, j in zip(lo, hi)], pa.binary())

        columns = [each(lambda z: keys[z]), each(lambda z: texts[z]), each(lambda z: pos[z].astype(np.int32)), each(lambda z: ctx[z]), pa.array([np.ascontiguousarray(followers[follow == j]).tobytes() for j in some], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *columns], ["bucket", "keys", "texts", "pos", "ctx", "followers"])

    def match(t: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])

        keys, texts, pos = column("keys", np.uint64), column("texts", np.int64), column("pos", np.int32).astype(np.int64)
        ctx, followers = column("ctx", np.uint32).reshape(-1, m.left + m.right), column("followers", np.int64).reshape(-1, 3)
        order = np.lexsort((pos, texts))  # a text that several batches hold stands there once
        once = order[np.concatenate([[True], (texts[order][1:] != texts[order][:-1]) | (pos[order][1:] != pos[order][:-1])])]
        once = once[np.argsort(keys[once], kind="stable")]
        keys, texts, pos = keys[once], texts[once], pos[once]
        shared = [np.empty((0, 4), np.int64)]
        for i, j in parts_of(keys, TOGETHER):
            found = compare(keys[i:j], texts[i:j], pos[i:j], ctx[once[i:j]], m)
            found[:, 0] += i
            shared.append(found)
        shared = np.concatenate(shared)
        shared = shared[np.argsort(shared[:, 0], kind="stable")]
        if not within:
            shared = shared[shared[:, 2] != shared[:, 3]]
        spans = [spans_of(texts[shared[:, 0]], pos[shared[:, 0]], shared[:, 1:], m)]
        if len(followers):
            code = place(texts, pos)
            order = np.argsort(code)
            suffix = order[np.searchsorted(code[order], followers[:, 2].view(np.uint64))]
            lo, hi = np.searchsorted(shared[:, 0], suffix), np.searchsorted(shared[:, 0], suffix, "right")
            who = np.repeat(np.arange(len(followers)), hi - lo)
            at = np.arange(len(who)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            spans.append(spans_of(followers[who, 0], followers[who, 1], shared[at, 1:], m))
        spans = np.unique(np.concatenate(spans), axis=0)
        return pa.table({"name": pa.array(spans[:, 0]), "start": pa.array(spans[:, 1]), "end": pa.array(spans[:, 2]), "other": pa.array(spans[:, 3])})

    packed = map_arrow(rows, pack, "bucket int, keys binary, texts binary, pos binary, ctx binary, followers binary", PACK)
    spans = packed.groupBy("bucket").applyInArrow(match, "name long, start long, end long, other long")

    def unite(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("other", pa.int64())]))
        for b in slices(batches, 2000):
            each = [united([(s["start"], s["end"], s["other"]) for s in x]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(each, kind)], ["name", "s"])

    found = spans.groupBy("name").agg(F.collect_set(F.struct("start", "end", "other")).alias("s")).mapInArrow(unite, "name long, s array<struct<start:long,end:long,other:long>>")

    def sized(b):
        each = [ascii_words(x) for x in raw_bytes(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in each], pa.int64()), pa.array([named(w) for w in each], pa.int64())], ["id", "n_words", "name"])

    about = cut(map_arrow(rows, sized, "id long, n_words long, name long").where(F.col("n_words") >= passage).distinct())
    texts = about.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    called = texts.select(F.col("name").alias("other"), F.col("a").alias("id"))
    found = found.select("name", F.explode("s").alias("p")).select("name", "p.*").join(called, "other")
    found = found.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("id").alias("other")))).alias("s"))
    both = about.join(texts, "name").join(found, "name", "left").where(F.col("s").isNotNull() | (F.col("a") < F.col("z")))
    copy = F.when(F.col("a") < F.col("z"), F.when(F.col("id") == F.col("a"), F.col("z")).otherwise(F.col("a")))
    none = F.lit(None).cast("array<struct<start:long,end:long,other:long>>")
    own = F.when(copy.isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), copy.alias("other")))).otherwise(F.coalesce("s", none))
    others = F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col("s")["other"], F.array().cast("array<long>")), F.when(copy.isNotNull(), F.array(copy)).otherwise(F.array().cast("array<long>")))))
    total = F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return both.select(F.col("id").alias(key), "n_words", total.alias("n_repeated"), others.alias("others"), own.alias("spans"))


def named(words: list[bytes]) -> int:
    """64 bits of a digest of a text's words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    k, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])
