"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree over the DEPTH bytes before it. At every context the
Krichevsky-Trofimov estimate of the counts seen there, and the product of what the contexts one byte longer make of
their own shares, weigh one half each; the logarithms of these sums over the training text give the mixing weights, and
a prediction mixes the estimates of all depths along the path from the root. A decision that a context never met is
predicted as its longest suffix that met it does, which then stands for a leaf; one never met at all has 1/2. The model
is learned once and then fixed, so a text's probability doesn't depend on what else is scored. Every context of the
training text is in the tree, however rare: it grows with the corpus.

How it is spread out: documents are dealt to chunks by hash, compressed. A chunk hands on its distinct runs (a byte with the DEPTH
bytes before it) and tokens, each with its count in training documents, packed by bucket. A run's bucket is that of the
last SPLIT bytes of its context, so a bucket holds whole subtrees of the tree: it sums the counts and works its subtrees out
from the leaves up. What they come to is summed by the contexts that are shorter than SPLIT bytes, of which there are at
most 256^(SPLIT - 1) * 255 decisions whatever the corpus; the driver mixes those and sends them back to the buckets, which
then work down to the probability of each run. A chunk gets its runs' back in the order in which it sent them, and sums
them up for its documents. The largest thing that one task holds is the distinct runs of one bucket, or of one pair of bytes.

Texts are lower-cased (A-Z); they start in a context of 0xFF bytes, which UTF-8 lacks, and end with one. Tokens are told
apart by 64 bits of a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, crc_bucket, cut, give_back, hash_words, mix, raw_bytes, slices

DEPTH, SPLIT = 6, 2
EDGE = 0xFF
#: The token after each text: no word has a blank.
END = np.array([xxhash.xxh3_64_intdigest(b" end")], np.uint64)
#: Bytes of text in a chunk, in what is worked on at a time, and for which there is a bucket of runs (about one run, counted once
#: for each chunk, for 8 bytes); for so many buckets of runs there is one of tokens.
CHUNK, PIECE, PER_BUCKET, TOKENS = 12_000_000, 1_000_000, 12_000_000, 8
#: Bytes of rows that a task packs for their chunks together.
PACK = 16_000_000
#: How far probabilities stay from 0 and 1.
LEAST = 2.0**-40
HEADER, PLACES, SHORT, COUNTS, TOTALS = range(5)


def codes_of(buffer: np.ndarray, depth: int) -> np.ndarray:
    """Of each byte but the first depth ones: the byte with the depth bytes before it, as one number, the byte lowest."""
    code, width = buffer, 1  # doubled in width: the byte, then those before it further up
    while width <= depth:
        wider = code.astype(f"u{2 * width}")
        wider[width:] |= code[:-width].astype(wider.dtype) << (8 * width)
        code, width = wider, 2 * width
    return code[depth:].astype(np.uint64) & np.uint64(256 ** (depth + 1) - 1)


def runs(texts: list[bytes | None], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the texts' bytes and ends, at most about PIECE at a time, with the number of the text that each is of."""
    edge = bytes([EDGE])
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop] or b"") < PIECE):
            size += len(texts[stop] or b"") + 1
            stop += 1
        if stop == at + 1 and size > 2 * PIECE:
            whole = np.frombuffer(edge * depth + texts[at].lower() + edge, np.uint8)
            for i in range(0, size, PIECE):
                part = whole[i : i + PIECE + depth]
                yield codes_of(part, depth), np.full(len(part) - depth, at)
        else:
            some = texts[at:stop]
            sizes = np.array([len(t or b"") + 1 for t in some], np.int64)
            buffer = np.frombuffer(b"".join(edge * depth + (t or b"").lower() + edge for t in some), np.uint8)
            starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
            own = np.ones(len(buffer), bool)
            own[(starts[:, None] + np.arange(depth)).ravel()] = False
            yield codes_of(buffer, depth)[own[depth:]], np.repeat(np.arange(at, stop), sizes)
        at = stop


def squeezed(a: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers of 64 bits as compressed bytes; of rising ones the steps. The numbers' bytes of equal weight stand together."""
    a = a.astype(np.uint64, copy=False)
    steps = np.diff(a, prepend=np.uint64(0)) if rising else a
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="lz4", asbytes=True)


def unsqueezed(raw: bytes, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * n, codec="lz4", asbytes=True), np.uint8).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64) if rising else steps


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts (or how often they stand there)."""
    if counts is None:
        keys = np.sort(keys)
        at = _edges(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = _edges(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def bucket_of(keys: np.ndarray, buckets: int, split: int) -> np.ndarray:
    """Buckets of runs by the split bytes before the last one."""
    suffix = mix((keys >> np.uint64(8)) & np.uint64(256**split - 1))
    return (((suffix >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def token_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(keys) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def distinct_runs(texts: list[bytes | None], train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct runs in order, and how often each stands in training texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for learned in (True, False):
        some = [t for t, own in zip(texts, train) if own == learned]
        for codes, _ in runs(some, depth):
            keys, n = summed(codes)
            held.append((keys, n if learned else np.zeros(len(keys), np.int64)))
    return summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, and the number of the text that each is of."""
    each = [hash_words(ascii_words(t)) for t in texts]
    sizes = np.array([len(h) + 1 for h in each], np.int64)
    return np.concatenate([x for h in each for x in (h, END)]), np.repeat(np.arange(len(texts)), sizes)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8; x > 0."""
    y = x + 8.0
    low = np.log(x)
    for i in range(1, 8):
        low += np.log(x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


_TABLE = 1 << 14
_HALVES, _WHOLES = log_gamma(np.arange(_TABLE) + 0.5), log_gamma(np.arange(_TABLE) + 1.0)


def _tabled(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    out = table[np.minimum(n, _TABLE - 1)]
    large = np.flatnonzero(n >= _TABLE)
    if len(large):
        out[large] = log_gamma(n[large] + more)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _tabled(zeros, _HALVES, 0.5) + _tabled(ones, _HALVES, 0.5) - math.log(math.pi) - _tabled(zeros + ones, _WHOLES, 1.0)


class Subtrees:
    """The part of the context tree above given runs, from contexts of top bytes down to those of depth bytes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int, top: int):
        """codes: distinct runs in order; n: their counts in training text, which may be 0."""
        self.depth, self.top = depth, top
        self.keys, self.n, self.up = {depth: codes}, {depth: n.astype(np.int64)}, {}
        for d in range(depth - 1, top - 1, -1):
            short = self.keys[d + 1] & np.uint64(256 ** (d + 1) - 1)
            order = np.argsort(short)
            short = short[order]
            at = _edges(short)
            up = np.empty(len(order), np.int32)
            up[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(order))))
            self.keys[d], self.n[d], self.up[d + 1] = short[at], np.add.reduceat(self.n[d + 1][order], at) if len(at) else self.n[d + 1][order], up

    def decisions(self, level: int):
        """Decisions of one level (its bit of the byte) by depth: first run, row of each run, row one depth up, zeros, ones, log of KT, log of the mixture."""
        rows: dict[int, dict[str, np.ndarray]] = {}
        for d in range(self.depth, self.top - 1, -1):
            keys, n = self.keys[d], self.n[d]
            first = _edges(keys >> np.uint64(8 - level))
            row = np.zeros(len(keys), np.int32)
            row[first[1:]] = 1
            row = np.cumsum(row, dtype=np.int32)
            bit = ((keys >> np.uint64(7 - level)) & np.uint64(1)).astype(np.int64)
            ones = np.add.reduceat(n * bit, first) if len(first) else n
            zeros = (np.add.reduceat(n, first) if len(first) else n) - ones
            rows[d] = {"first": first, "row": row, "zeros": zeros, "ones": ones, "kt": log_kt(zeros, ones)}
            if d < self.depth:
                below = rows[d + 1]
                below["up"] = row[self.up[d + 1][below["first"]]]
                rows[d]["below"] = np.bincount(below["up"], below["mixed"], len(first))
                rows[d]["mixed"] = np.logaddexp(rows[d]["kt"], rows[d]["below"]) + math.log(0.5)
            else:
                rows[d]["mixed"] = rows[d]["kt"]
        return rows

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Decisions of the shortest contexts (key: context, then the decision's number from 1 to 255), zeros, ones, and the sum of the mixtures one byte longer."""
        out = []
        for level in range(8):
            top = self.decisions(level)[self.top]
            out.append((decision(self.keys[self.top][top["first"]], level), top["zeros"], top["ones"], top["below"]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def log10(self, short: "Short") -> np.ndarray:
        """The log10 probability of each run's byte."""
        out = np.zeros(len(self.keys[self.depth]))
        bytes_ = self.keys[self.depth] & np.uint64(255)
        for level in range(8):
            rows = self.decisions(level)
            a, b, leaf = short.at(decision(self.keys[self.top][rows[self.top]["first"]], level))
            for d in range(self.top + 1, self.depth + 1):
                r = rows[d]
                seen, kt = r["zeros"] + r["ones"] > 0, (r["ones"] + 0.5) / (r["zeros"] + r["ones"] + 1)
                own = np.exp(r["kt"] + math.log(0.5) - r["mixed"]) if d < self.depth else np.ones(len(kt))
                a, b, leaf = a[r["up"]], b[r["up"]], leaf[r["up"]]
                leaf = np.where(seen, a + b * kt, leaf)
                a, b = a + b * own * kt, b * (1 - own)
            p = np.clip(leaf[rows[self.depth]["row"]], LEAST, 1 - LEAST)
            out += np.log10(np.where((bytes_ >> np.uint64(7 - level)) & np.uint64(1), p, 1 - p))
        return out


def decision(keys: np.ndarray, level: int) -> np.ndarray:
    """The context of a run, then the number of its decision at a level: 1, or twice the one before, or that and one."""
    number = np.uint64(1 << level) + ((keys & np.uint64(255)) >> np.uint64(8 - level))
    return (keys >> np.uint64(8) << np.uint64(8)) | number


class Short:
    """The tree's contexts of up to top bytes, mixed from the root: what Subtrees need of them."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, top: int):
        """As of Subtrees.sums, summed over all subtrees."""
        levels = [(keys, zeros, ones, below)]
        for d in range(top - 1, -1, -1):
            keys, zeros, ones, below = levels[0]
            mixed = np.logaddexp(log_kt(zeros, ones), below) + math.log(0.5)
            short = (((keys >> np.uint64(8)) & np.uint64(256**d - 1)) << np.uint64(8)) | (keys & np.uint64(255))
            up, back = np.unique(short, return_inverse=True)
            total = [np.bincount(back, x, len(up)) for x in (zeros, ones)]
            levels.insert(0, (up, *(t.astype(np.int64) for t in total), np.bincount(back, mixed, len(up))))
        before = None
        for d, (keys, zeros, ones, below) in enumerate(levels):
            kt, seen = log_kt(zeros, ones), zeros + ones > 0
            own = np.exp(kt + math.log(0.5) - (np.logaddexp(kt, below) + math.log(0.5)))
            estimate = (ones + 0.5) / (zeros + ones + 1)
            if before is None:
                a, b, leaf = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), 0.5)
            else:
                short = (((keys >> np.uint64(8)) & np.uint64(256 ** (d - 1) - 1)) << np.uint64(8)) | (keys & np.uint64(255))
                up = np.searchsorted(before[0], short)
                a, b, leaf = (x[up] for x in before[1:])
            leaf = np.where(seen, a + b * estimate, leaf)
            before = keys, a + b * own * estimate, b * (1 - own), leaf
        self.keys, self.a, self.b, self.leaf = before

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, keys)
        return self.a[i], self.b[i], self.leaf[i]


def _packed(bucket: np.ndarray, keys: np.ndarray, n: np.ndarray):
    """Buckets that hold some of the rising keys, with those and their counts as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys = bucket[order], keys[order]
    at = _edges(bucket)
    ends = np.append(at[1:], len(bucket))
    counts = n[order]
    return [(int(bucket[i]), squeezed(keys[i:j], True), squeezed(counts[i:j])) for i, j in zip(at, ends)]


def _merged(t: pa.Table, depth: int, split: int, runs_end: int) -> pa.Table:
    """A bucket's runs or tokens (bucket, chunk, keys, n of each chunk): counts summed, and each chunk's places in them."""
    bucket = t.column("bucket")[0].as_py()
    chunks = t.column("chunk").to_pylist()
    keys = [unsqueezed(x, True) for x in t.column("keys").to_pylist()]
    known, counts = summed(np.concatenate(keys), np.concatenate([unsqueezed(x).astype(np.int64) for x in t.column("n").to_pylist()]))
    rows: list[tuple] = []  # chunk, kind, a, b, key, zeros, ones, below
    if bucket < runs_end:
        rows.append((-1, HEADER, squeezed(known, True), squeezed(counts), None, None, None, None))
        rows += [(c, PLACES, squeezed(np.searchsorted(known, k), True), None, None, None, None, None) for c, k in zip(chunks, keys)]
        rows += [(-1, SHORT, None, None, *r) for r in zip(*(x.tolist() for x in _signed(Subtrees(known, counts, depth, split - 1).sums())))]
    else:
        rows += [(c, COUNTS, squeezed(counts[np.searchsorted(known, k)]), None, None, None, None, None) for c, k in zip(chunks, keys)]
        rows.append((-1, TOTALS, None, None, None, int(counts.sum()), int((counts > 0).sum()), None))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.Table.from_arrays([pa.array([bucket] * len(rows), pa.int32()), *columns], ["bucket", "chunk", "kind", "a", "b", "key", "zeros", "ones", "below"])


def _wrapped(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """chunk, rows: the rows (id, train, x, chunk) of each chunk as a compressed stream."""
    t = pa.Table.from_batches(batches)
    chunk = t.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    at = _edges(chunk[order])
    out = []
    for some in np.split(order, at[1:]):
        sink = pa.BufferOutputStream()
        rows = t.take(pa.array(some)).combine_chunks()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(rows)
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(chunk[order][at], pa.int32()), pa.array(out, pa.binary())], ["chunk", "rows"])


def _unwrapped(t: pa.Table) -> tuple[int, pa.Table]:
    """A chunk and its rows."""
    return t.column("chunk")[0].as_py(), pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in t.column("rows").to_pylist()])


def _signed(columns):
    keys, *rest = columns
    return keys.view(np.int64), *rest


def scores(docs: DataFrame, train, depth: int = DEPTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    train: the condition on rows that are learned from (null: not). Null and empty texts are one end. Repeated rows are
    scored each, as are rows with a null key. An empty table gives an empty result; without training rows every decision
    has probability 1/2. Other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    split = min(SPLIT, depth)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("x"))
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("x").cast("long")), F.lit(0)), F.count("*")).first()
    n_chunks = max(1, -(-(size + n_rows) // CHUNK))
    runs_end = max(1, (size + n_rows) // PER_BUCKET)
    buckets = runs_end + 1 + runs_end // TOKENS
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "x"), F.lit(n_chunks)).cast("int"))

    def wrap(batches):
        """Rows of a chunk that stand in one task, compressed together."""
        held, n = [], 0
        for b in slices(batches, 1000):
            held.append(b)
            n += b.nbytes
            if n >= PACK:
                yield _wrapped(held)
                held, n = [], 0
        if held:
            yield _wrapped(held)

    wrapped = dealt.mapInArrow(wrap, "chunk int, rows binary")

    def hand_on(t: pa.Table) -> pa.Table:
        chunk, t = _unwrapped(t)
        texts, own = raw_bytes(t.column("x")), np.array(t.column("train").to_pylist(), bool)
        keys, n = distinct_runs(texts, own, depth)
        out = _packed(bucket_of(keys, runs_end, split), keys, n)
        hashes, who = token_hashes(texts)
        keys, n = summed(hashes, own[who].astype(np.int64))
        out += _packed(runs_end + token_bucket(keys, buckets - runs_end), keys, n)
        give_back()
        columns = zip(*out)
        return pa.table({"bucket": pa.array(next(columns), pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int32()), "keys": pa.array(next(columns), pa.binary()), "n": pa.array(next(columns), pa.binary())})

    handed = wrapped.groupBy("chunk").applyInArrow(hand_on, "bucket int, chunk int, keys binary, n binary")
    merged = cut(handed.groupBy("bucket").applyInArrow(lambda t: _merged(t, depth, split, runs_end), "bucket int, chunk int, kind int, a binary, b binary, key long, zeros long, ones long, below double"))
    # at most 256^(SPLIT - 1) * 255 decisions
    short = merged.where(F.col("kind") == SHORT).groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toPandas().sort_values("key")
    n_all, n_kinds = merged.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("zeros"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    bottom = n_all + 0.5 * (n_kinds + 1)
    shared = spark.sparkContext.broadcast(Short(short["key"].to_numpy(np.int64).view(np.uint64), *(short[c].to_numpy(t) for c, t in (("zeros", np.int64), ("ones", np.int64), ("below", np.float64))), split - 1))

    def worked_down(batches):
        """Rows of a bucket follow its header."""
        found = None
        for b in batches:
            out: list[list] = [[], [], []]
            for bucket, chunk, what, a, counts in zip(*(b.column(i).to_pylist() for i in range(5))):
                if what == HEADER:
                    found = Subtrees(unsqueezed(a, True), unsqueezed(counts), depth, split - 1).log10(shared.value).astype(np.float32)
                    continue
                for column, value in zip(out, (chunk, bucket, found[unsqueezed(a, True).astype(np.int64)].tobytes() if what == PLACES else a)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["chunk", "bucket", "a"])
        give_back()

    worked = merged.where(F.col("kind").isin(HEADER, PLACES, COUNTS)).select("bucket", "chunk", "kind", "a", "b").mapInArrow(worked_down, "chunk int, bucket int, a binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        _, left = _unwrapped(left)
        texts, own = raw_bytes(left.column("x")), np.array(left.column("train").to_pylist(), bool)
        given = dict(zip(right.column("bucket").to_pylist(), right.column("a").to_pylist()))
        known = summed(np.concatenate([summed(c)[0] for c, _ in runs(texts, depth)]))[0]
        bucket = bucket_of(known, runs_end, split)
        logs = np.empty(len(known))
        logs[np.argsort(bucket, kind="stable")] = np.concatenate([np.frombuffer(given[j], np.float32) for j in np.unique(bucket).tolist()])
        result = np.zeros(len(texts))
        for codes, who in runs(texts, depth):
            order = np.argsort(codes)
            codes = codes[order]
            at = _edges(codes)
            each = np.repeat(logs[np.searchsorted(known, codes[at])], np.diff(np.append(at, len(codes))))
            result += np.bincount(who[order], each, len(texts))
        hashes, who = token_hashes(texts)
        known = np.unique(hashes)
        bucket = runs_end + token_bucket(known, buckets - runs_end)
        counts = np.empty(len(known), np.int64)
        counts[np.argsort(bucket, kind="stable")] = np.concatenate([unsqueezed(given[j]).astype(np.int64) for j in np.unique(bucket).tolist()])
        c = counts[np.searchsorted(known, hashes)]
        base = np.bincount(who, np.log10((c + 0.5) / bottom), len(texts))
        n, n_known = np.bincount(who, minlength=len(texts)), np.bincount(who[c > 0], minlength=len(texts))
        sizes = np.array([len(t or b"") + 1 for t in texts])
        give_back()
        return pa.table(
            {key: left.column("id"), "held_out": pa.array(~own), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "train_tokens": pa.array(np.full(len(texts), n_all, np.int64))}
            | {"base_score": pa.array(base), "score": pa.array(result), "bits_per_byte": pa.array(-result / math.log10(2) / sizes)}
        )

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return wrapped.groupBy("chunk").cogroup(worked.groupBy("chunk")).applyInArrow(score, schema)


def held_out_scores(docs: DataFrame) -> DataFrame:
    return scores(docs, F.coalesce(crc_bucket("doc_id", 5) != 1, F.lit(True)))
