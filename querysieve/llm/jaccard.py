"""Exact n-gram Jaccard join by PartEnum signatures.

Sets of sizes s and t with Jaccard >= num/den differ in at most k = (s + t)(den - num)/(den + num) elements. Sizes are
cut into bands; a set signs for its own band and for the next one if a partner there is possible, so each similar pair
has a band in common. For a band the element domain is dealt by hash into n1 groups of n2 parts. Of n1 groups at
least n1 - k//(k2+1) hold at most k2 differing elements, and in such a group some n2 - k2 parts are equal: each such
subset of parts, for each group, gives one signature, and similar sets share one.

Two things keep candidates few without losing a pair:
* Empty subsets say nothing and are not signed. Where groups have one part each, the first k + 1 parts that are not
  empty will do: before the first part that two similar sets share, each has at most k others. A set with fewer, or
  otherwise with too many empty subsets, is called sparse.
* Leaving fixed elements out of all sets only lowers their difference. Frequent shingles (found in a bounded sample,
  which decides cost, not results) are left out, so that a common passage makes no candidates. A set that is sparse
  without them also signs its first elements in an order that has frequent shingles last: of two similar sets, each
  holds an element of the other among its first n - ceil(n * num/den) + 1. Two such sets meet there.

A node is a distinct shingle set, named by 64 bits of its digest, so copies take no further part than one link each.
Signatures are packed by hash bucket and sorted bucket by bucket; each run of equal signatures is a row. In a run each
node names a leader, the one that has most in common with others; a node's most frequent leader is checked. After
components of those links, only pairs of a run whose members are still in different components are compared: first in
the largest run of each node, where whole sets are compared inside a task and only links that join two components come
out; then in the other runs, but for pairs that have met in one of those. A pair is thus either checked or already in
one component, whatever the size of the groups of copies, and no group's pairs are spelled out.

Sets of 64-bit shingle hashes stand for sets of shingles.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, cut, gram_hashes, hash_words, map_arrow, mix, raw_bytes, release, slices, tidy
from .components import components

SHINGLE, NUM, DEN = 5, 80, 100
#: Signatures that one task sorts at a time, those packed together, and documents of a batch.
PER_BUCKET, TOGETHER, PACK = 600_000, 1_000_000, 2000
#: Members of a run that are compared with each other at a time, and bits of a table of what they have in common.
BLOCK, BITS = 4096, 1 << 28
#: Slots of the filter of texts by id: they bound what is broadcast, and decide no result.
SLOTS = 1 << 20
#: Members of a run in one row.
LISTED = 4096
#: Documents sampled for frequent shingles, documents of the sample that make one frequent, and the most kept.
SAMPLED, FREQUENT, MOST = 8_000, 8, 1 << 18


def shingle_set(raw: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words none."""
    h = hash_words(ascii_words(raw))
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


class Bands:
    """Size bands and the PartEnum parameters of each."""

    def __init__(self, num: int = NUM, den: int = DEN, ratio: float = 1.4):
        self.num, self.den = num, den
        self.lo: list[int] = [1]
        self.hi: list[int] = []
        while self.lo[-1] < 1 << 31:
            self.hi.append(max(self.lo[-1], int(self.lo[-1] * ratio)))
            self.lo.append(self.hi[-1] + 1)
        self.lo.pop()
        self.plan = [self.parameters(2 * hi * (den - num) // (den + num)) for hi in self.hi]

    @staticmethod
    def parameters(k: int) -> tuple[int, int, int, int]:
        """k, n1, n2, k2: small differences in one group of parts, larger ones dealt to more groups than they spoil."""
        if k == 0:
            return 0, 1, 1, 0
        if k <= 3:
            return k, 1, k + 2, k
        return k, math.ceil(1.35 * (k + 1)), 1, 0

    def of(self, n: int) -> list[int]:
        """The bands that a set of n elements signs for."""
        own = int(np.searchsorted(self.lo, n, "right")) - 1
        return [own, own + 1] if own + 1 < len(self.lo) and self.num * self.lo[own + 1] <= self.den * n else [own]


BANDS = Bands()


def band_signatures(s: np.ndarray, band: int, plan: tuple[int, int, int, int]) -> tuple[np.ndarray, bool]:
    """Signatures of a sorted set for a band, and whether it is sparse there."""
    k, n1, n2, k2 = plan
    fine = n1 * n2
    base = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    sums, full = np.zeros(fine, np.uint64), np.zeros(fine, bool)
    if len(s):
        part = ((s >> np.uint64(32)) * np.uint64(fine)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        at = part[starts].astype(np.int64)
        sums[at] = np.add.reduceat(mix(s ^ base), starts)
        full[at] = True
    if n2 == 1:
        chosen = np.flatnonzero(full)[: k + 1]
        return mix(sums[chosen] + mix(base + chosen.astype(np.uint64))), len(chosen) <= k
    sums, full = sums.reshape(n1, n2), full.reshape(n1, n2)
    weight = mix(base + np.arange(fine, dtype=np.uint64)).reshape(n1, n2) | np.uint64(1)
    subsets = [list(c) for c in combinations(range(n2), n2 - k2)]
    signed = np.stack([(sums[:, c] * weight[:, c]).sum(axis=1, dtype=np.uint64) + np.uint64(i + 1) for i, c in enumerate(subsets)], axis=1)
    filled = np.stack([full[:, c].any(axis=1) for c in subsets], axis=1)
    out = mix(signed + mix(base + np.arange(n1, dtype=np.uint64))[:, None])
    return out[filled], int((~filled).any(axis=1).sum()) >= n1 - k // (k2 + 1)


def signatures(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, bands: Bands = BANDS) -> np.ndarray:
    """All signatures of a sorted set. frequent: sorted shingles that are left out, with how frequent they are."""
    if not len(s):
        return np.empty(0, np.uint64)
    rare, common = s, s[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        hit = frequent[at] == s
        rare, common = s[~hit], s[hit][np.lexsort((s[hit], counts[at[hit]]))]
    out, any_sparse = [], False
    for band in bands.of(len(s)):
        signed, sparse = band_signatures(rare, band, bands.plan[band])
        out.append(signed)
        any_sparse |= sparse
    if any_sparse:
        first = len(s) + (-bands.num * len(s) // bands.den) + 1
        out.append(mix(np.concatenate([rare[:first], common[: max(0, first - len(rare))]]) + np.uint64(1)))
    return np.unique(np.concatenate(out))


def frequent_shingles(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many documents of a sample of about SAMPLED share, at most MOST, and how many do."""
    share = SAMPLED / max(1, docs.count())
    sample = docs.select(text) if share >= 1 else docs.select(text).where(F.pmod(F.xxhash64(text, F.lit("frequent")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches):
        for b in slices(batches, PACK):
            found = [shingle_set(r, k) for r in raw_bytes(b.column(0))]
            s, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])

    counts = sample.mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "s").limit(MOST).toPandas()
    found, n = rows["s"].to_numpy(np.int64, copy=True).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(found)
    return found[order], n[order]


def node(s: np.ndarray) -> tuple[bytes, int]:
    """Digest of a shingle set, and its first 64 bits as a number: sets of equal numbers are told apart when checked."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def _described(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, n_shingles, a digest of the shingle set (null if empty), its node and its bitmap."""

    def one(b):
        sizes, digests, nodes, maps = [], [], [], []
        for raw in raw_bytes(b.column(1)):
            s = shingle_set(raw, k)
            digest, name = node(s) if len(s) else (None, None)
            sizes.append(len(s))
            digests.append(digest)
            nodes.append(name)
            maps.append(bitmap(s))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary())], [key, "n_shingles", "_digest", "_node", "_map"])

    return map_arrow(docs.select(key, text), one, f"`{key}` {dict(docs.dtypes)[key]}, n_shingles long, _digest binary, _node long, _map binary", 500)


def bitmap(s: np.ndarray) -> bytes:
    """Which cells of the hash range a set touches; four cells an element at least, a power of two."""
    bits = max(6, int(4 * len(s) - 1).bit_length())
    cells = np.zeros(1 << bits, bool)
    cells[s >> np.uint64(64 - bits)] = True
    return np.packbits(cells).tobytes()


def may_be_similar(n: int, x: bytes, m: int, y: bytes, num: int, den: int) -> bool:
    """A bound from bitmaps: a cell that only x touches holds an element that y lacks."""
    if den * min(n, m) < num * max(n, m):
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        few = 8 * min(len(a), len(b))
        a, b = (np.packbits(np.unpackbits(c).reshape(few, -1).any(axis=1)) for c in (a, b))
    both = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return den * both >= num * (n + m - both)


def _possible(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Ids (a, b) of those of the pairs of nodes that their bitmaps don't rule out."""
    known = sets.select("node", F.struct("n", "map", "id").alias("s"))
    sided = pairs.join(known.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(known.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    def check(batches):
        for b in slices(batches, 2000):
            columns = [b.column(i).field(j).to_pylist() for i in (0, 1) for j in (0, 1)]
            good = [may_be_similar(n, x, m, y, bands.num, bands.den) for n, x, m, y in zip(*columns)]
            yield pa.RecordBatch.from_arrays([b.column(0).field(2), b.column(1).field(2)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut(sided.select("sa", "sb").mapInArrow(check, "a long, b long").where("a != b").distinct())


def packed_signatures(sets: list[tuple[int, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Signatures of nodes by bucket of their range: a row holds those of one bucket, and the nodes that have any there."""
    nodes = np.array([n for n, _ in sets], np.int64)
    sigs, who = np.concatenate([x for _, x in sets]), np.repeat(np.arange(len(sets)), [len(x) for _, x in sets])
    bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    sigs, who, bucket = sigs[order], who[order], bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows: list[list] = [[], [], [], []]
    for lo, hi in zip(starts, np.append(starts[1:], len(sigs))):
        some, at = np.unique(who[lo:hi], return_inverse=True)
        for column, value in zip(rows, (int(bucket[lo]), sigs[lo:hi].tobytes(), at.astype(np.uint16).tobytes(), nodes[some].tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "sigs", "who", "nodes"])


def equal_runs(sigs: np.ndarray, nodes: np.ndarray) -> pa.Table:
    """sig, nodes, lead: the runs of equal signatures of two nodes or more, in rows of at most LISTED members.

    How much a node has in common with others is what its runs' sizes come to; a run's leader is the member with most.
    """
    ordered = np.sort(sigs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        kept = twice[np.minimum(np.searchsorted(twice, sigs), len(twice) - 1)] == sigs
        sigs, nodes = sigs[kept], nodes[kept]
        order = np.lexsort((nodes, sigs))
        sigs, nodes = sigs[order], nodes[order]
        new = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])])
        sigs, nodes = sigs[new], nodes[new]
        starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
        sizes = np.diff(np.append(starts, len(sigs)))
        kept = np.repeat(sizes > 1, sizes)
        sigs, nodes = sigs[kept], nodes[kept]
    else:
        sigs, nodes = sigs[:0], nodes[:0]
    if not len(sigs):
        return pa.table({"sig": pa.array([], pa.int64()), "nodes": pa.array([], pa.list_(pa.int64())), "lead": pa.array([], pa.int64())})
    starts = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    sizes = np.diff(np.append(starts, len(sigs)))
    run = np.repeat(np.arange(len(starts)), sizes)
    _, who = np.unique(nodes, return_inverse=True)
    score = np.bincount(who, np.repeat(sizes, sizes))[who]
    lead = nodes[np.lexsort((nodes, -score, run))[starts]]
    rows = np.flatnonzero((np.arange(len(run)) - starts[run]) % LISTED == 0)
    listed = pa.ListArray.from_arrays(pa.array(np.append(rows, len(nodes)), pa.int32()), pa.array(nodes))
    return pa.table({"sig": pa.array(sigs[rows].view(np.int64)), "nodes": listed, "lead": pa.array(lead[run[rows]])})


def _runs(docs: DataFrame, text: str, k: int, bands: Bands, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """sig, nodes, lead: see equal_runs."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST numbers

    def pack(batches):
        held, seen, n = [], set(), 0
        for b in slices(batches, PACK):
            for raw in raw_bytes(b.column(0)):
                s = shingle_set(raw, k)
                if len(s) and (name := node(s)[1]) not in seen:
                    seen.add(name)
                    held.append((name, signatures(s, *shared.value, bands)))
                    n += len(held[-1][1])
                    if n >= TOGETHER or len(held) > 65_000:
                        yield packed_signatures(held, buckets)
                        held, seen, n = [], set(), 0
        if n:
            yield packed_signatures(held, buckets)

    def match(t: pa.Table) -> pa.Table:
        sigs = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("sigs").to_pylist()])
        nodes = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(w, np.uint16)] for w, i in zip(t.column("who").to_pylist(), t.column("nodes").to_pylist())])
        return equal_runs(sigs, nodes)

    packed = docs.select(text).mapInArrow(pack, "bucket int, sigs binary, who binary, nodes binary")
    return packed.groupBy("bucket").applyInArrow(match, "sig long, nodes array<long>, lead long")


def _by_run(members: DataFrame, columns: list[str], compare, schema: str) -> DataFrame:
    """compare(own, *columns) of the members of each run (sig, node, component, m), or of each two blocks of a large one.

    compare is given arrays and whether two places may be compared: those of different blocks, or all in one block.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), own.alias("own"))))
    rows = members.withColumn("p", pairs).select("sig", "p.i", "p.j", "p.own", *columns)
    rows = rows.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(batches):
        at, held = None, []

        def flush():
            own, *values = map(list, zip(*held))
            own = np.array(own) if at[1] != at[2] else np.arange(len(own))
            return compare(at[0], own, *values)

        for b in slices(batches, 1000):
            for sig, i, j, own, *values in zip(*(raw_bytes(c) if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns)):
                if at != (sig, i, j) and held:
                    yield flush()
                    held = []
                at = sig, i, j
                held.append((own, *values))
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def _live(bands: Bands):
    """Nodes of a run that their bitmaps let be similar to one of another component."""

    def compare(sig, own, nodes, comps, n, maps):
        few = min(map(len, maps))
        m = np.stack([np.frombuffer(x if len(x) == few else np.packbits(np.unpackbits(np.frombuffer(x, np.uint8)).reshape(8 * few, -1).any(axis=1)).tobytes(), np.uint64) for x in maps])
        comps, n, found = np.array(comps), np.array(n), np.zeros(len(nodes), bool)
        for x in range(len(nodes) - 1):
            y = np.arange(x + 1, len(nodes))
            y = y[(comps[y] != comps[x]) & (own[y] != own[x]) & (bands.den * np.minimum(n[y], n[x]) >= bands.num * np.maximum(n[y], n[x]))]
            if not found[x] or not found[y].all():
                only_x, only_y = np.bitwise_count(m[x] & ~m[y]).sum(axis=1, dtype=np.int64), np.bitwise_count(m[y] & ~m[x]).sum(axis=1, dtype=np.int64)
                both = np.minimum(n[x] - only_x, n[y] - only_y)
                y = y[bands.den * both >= bands.num * (n[x] + n[y] - both)]
                found[y] = True
                found[x] |= len(y) > 0
        return pa.RecordBatch.from_arrays([pa.array([sig] * int(found.sum()), pa.int64()), pa.array(np.array(nodes, np.int64)[found])], ["sig", "node"])

    return compare


def in_common(sets: list[np.ndarray]):
    """A function of x and an array y: how many elements sets x and y have in common."""
    element, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # elements of one set alone are in no intersection
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = times[back] > 1
    who, column = who[kept], shared[back[kept]]
    width = -(-int((times > 1).sum()) // 64) * 64
    if len(sets) * width <= BITS:
        cells = np.zeros((len(sets), max(64, width)), bool)
        cells[who, column] = True
        bits = np.packbits(cells, axis=1).view(np.uint64)
        return lambda x, y: np.bitwise_count(bits[y] & bits[x]).sum(axis=1, dtype=np.int64)
    starts = np.searchsorted(who, np.arange(len(sets) + 1))
    order = np.argsort(column, kind="stable")
    ends = np.searchsorted(column[order], np.arange(width + 1))
    holders = who[order]

    def count(x, y):
        own = column[starts[x] : starts[x + 1]]
        return np.bincount(np.concatenate([holders[ends[c] : ends[c + 1]] for c in own]) if len(own) else np.empty(0, np.int64), minlength=len(sets))[y]

    return count


def _linked(k: int, bands: Bands):
    """Links (a, b) between components of a run: whole sets are compared, and a component that is joined is not compared again."""

    def compare(sig, own, ids, comps, texts):
        sets = [shingle_set(t, k) for t in texts]
        n, comps, ids, common = np.array([len(x) for x in sets]), np.array(comps), np.array(ids, np.int64), in_common(sets)
        out = []
        for x in range(len(ids) - 1):
            y = np.arange(x + 1, len(ids))
            y = y[(comps[y] != comps[x]) & (own[y] != own[x]) & (bands.den * np.minimum(n[y], n[x]) >= bands.num * np.maximum(n[y], n[x]))]
            if len(y):
                both = common(x, y)
                y = y[(n[x] > 0) & (bands.den * both >= bands.num * (n[x] + n[y] - both))]
                for c in np.unique(comps[y]).tolist():
                    out.append((ids[x], ids[y[comps[y] == c][0]]))
                comps[np.isin(comps, comps[y])] = comps[x]
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def _unmet(sig, own, nodes, comps, met):
    """Pairs (a, b) of nodes of different components that no run has compared yet."""
    runs, back = np.unique(np.concatenate([np.array(m, np.int64) for m in met]), return_inverse=True)
    cells = np.zeros((len(nodes), -(-len(runs) // 64) * 64), bool)
    cells[np.repeat(np.arange(len(nodes)), [len(m) for m in met]), back] = True
    bits, comps, nodes = np.packbits(cells, axis=1).view(np.uint64), np.array(comps), np.array(nodes, np.int64)
    out = [np.empty((0, 2), np.int64)]
    for x in range(len(nodes) - 1):
        y = np.arange(x + 1, len(nodes))
        y = y[(comps[y] != comps[x]) & (own[y] != own[x])]
        y = y[~(bits[y] & bits[x]).any(axis=1)]
        out.append(np.stack([np.maximum(nodes[y], nodes[x]), np.minimum(nodes[y], nodes[x])], axis=1))
    out = np.concatenate(out)
    return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def _texts(ids: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, t of the documents that a bounded filter of the ids lets pass: all that are wanted, and few others."""
    code = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")
    some = ids.select(code.alias("_code")).distinct()
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).withColumn("_code", code).join(F.broadcast(some), "_code", "left_semi").drop("_code")


def _similar(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, bands: Bands) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets are similar, checked on whole sets."""
    texts = _texts(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), docs, key, text)
    sided = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def check(batches):
        sets: dict[bytes, np.ndarray] = {}

        def of(raw):
            found = sets.get(raw)
            if found is None:
                if len(sets) >= 200:
                    sets.clear()
                found = sets[raw] = shingle_set(raw, k)
            return found

        for b in slices(batches, 500):
            good = []
            for ra, rb in zip(raw_bytes(b.column(2)), raw_bytes(b.column(3))):
                x, y = of(ra or b""), of(rb or b"")
                total = len(x) + len(y)
                if not len(x) or not len(y) or bands.den * min(len(x), len(y)) < bands.num * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(bands.den * common >= bands.num * (total - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return sided.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct()


def _apart(member: DataFrame, once: bool = False) -> DataFrame:
    """Members (sig, node, id, component) of runs over several components, with m, their number. once: of runs of the same members, one."""
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")] if once else []
    runs = member.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), *same).where("lo < hi")
    if once:
        runs = runs.groupBy("m", "x", "y").agg(F.min("sig").alias("sig"))
    return member.join(runs.select("sig", "m"), "sig")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, bands: Bands = BANDS) -> DataFrame:
    """key, n_shingles and component_id (least key that links lead to) of every row.

    Null, empty and wordless texts have no shingles and no links. Rows of equal key are one node; rows with a null key
    none (component null). Keys are whole numbers. Equal sets are linked without a comparison.
    """
    about = cut(_described(docs, key, text, k))
    shingles = about.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    if not shingles:
        return about.select(key, "n_shingles", F.col(key).cast("long").alias("component_id"))
    rows = about.where(f"_digest is not null and `{key}` is not null").select(F.col(key).cast("long").alias("id"), "_digest", "_node", "n_shingles", "_map")
    # each distinct set, with the least key that has it; the other keys are its copies
    sets = cut(rows.groupBy("_digest").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("_node").alias("node"), F.first("n_shingles").alias("n"), F.first("_map").alias("map")))
    copies = cut(rows.select("id", "_digest").join(sets.where("id < last").select("_digest", F.col("id").alias("first")), "_digest").where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())
    sets = sets.select("node", "id", "n", "map")
    runs = cut(_runs(docs.where(F.col(key).isNotNull()), text, k, bands, frequent_shingles(docs, text, k), max(1, math.ceil(0.8 * shingles / PER_BUCKET))))
    led = runs.select(F.explode("nodes").alias("a"), "lead").where("a != lead").groupBy("a", "lead").agg(F.count("*").alias("n"))
    best = cut(led.groupBy("a").agg(F.max_by("lead", F.struct("n", "lead")).alias("b")))
    links = copies.unionByName(cut(_similar(_possible(best, sets, bands), docs, key, text, k, bands)))
    joined = components(links)
    where = sets.select("node", "id").join(joined, "id", "left").select("node", "id", F.coalesce("component", "id").alias("component"))
    member = runs.select("sig", F.explode("nodes").alias("node")).join(where, "node")
    left = cut(_apart(member, once=True))
    release(runs)
    tidy(docs.sparkSession)
    # each node's largest run: whole sets
    homes = left.groupBy("node").agg(F.max(F.struct("m", "sig")).alias("r")).select("r.sig").distinct()
    home = cut(left.join(homes, "sig"))
    live = cut(_by_run(home.join(sets.select("node", "id", "n", "map"), ["node", "id"]), ["node", "component", "n", "map"], _live(bands), "sig long, node long").distinct())
    texts = _texts(live.join(home, ["sig", "node"]).select("id"), docs, key, text)
    more = cut(_by_run(live.join(home, ["sig", "node"]).join(texts, "id"), ["id", "component", "t"], _linked(k, bands), "a long, b long").distinct())
    links = links.unionByName(more)
    joined = components(links)
    # the other runs: pairs that have not met
    met = home.groupBy("node").agg(F.collect_set("sig").alias("met"))
    rest = _apart(left.join(homes, "sig", "left_anti").drop("component", "m").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    unmet = cut(_by_run(rest.join(met, "node"), ["node", "component", "met"], _unmet, "a long, b long").distinct())
    last = cut(_similar(_possible(unmet, sets, bands), docs, key, text, k, bands))
    final = components(links.unionByName(last))
    out = about.select(key, "n_shingles", F.col(key).cast("long").alias("id")).join(final, "id", "left")
    return out.select(key, "n_shingles", F.coalesce("component", "id").alias("component_id"))
