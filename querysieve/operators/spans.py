"""Span corruption and masking of token arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import EOS, pad

try:  # Python's own: on short texts several times as fast as the library's
    from _md5 import md5
except ImportError:
    from hashlib import md5

SENTINELS = 100  # id of the first sentinel; each further one is the next number


PAIR = "struct<input_ids: array<int>, labels: array<int>>"


def _lists(offsets: np.ndarray, values: pa.Array, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(null))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _corrupted(ids: pa.Array, mask: pa.Array, first: int, eos: int, step: int) -> pa.Array:
    """corrupt over one batch: all rows at once, by where each element of the results comes from."""
    null = np.asarray(pc.or_(ids.is_null(), mask.is_null()))
    sizes = _sizes(ids)
    tokens = ids.flatten().cast(pa.int32())
    if not np.array_equal(sizes, _sizes(mask)):
        mask = pa.array([(list(m or []) + [False] * n)[:n] for m, n in zip(mask.to_pylist(), sizes)], pa.list_(pa.bool_()))
    m = np.asarray(pc.fill_null(mask.flatten(), False)).astype(bool)
    row, starts, n = np.repeat(np.arange(len(sizes)), sizes), _ends(sizes), len(m)
    opens = m.copy()
    opens[1:] &= ~m[:-1] | (row[1:] != row[:-1])
    earlier = _ends(opens)
    nth = earlier[:-1] - earlier[starts[row]]  # runs of the row before this place
    most = int(nth.max()) + 1 if n else 0
    pool = pa.concat_arrays([tokens, pa.array(first + np.arange(most) * step, pa.int32()), pa.array([eos], pa.int32())])
    own, sentinel = np.arange(n), n + nth
    kept = ~m | opens
    inputs = np.where(opens, sentinel, own)[kept]
    taken = m.astype(np.int64) + opens
    at = _ends(taken)[:-1] + row  # each row before has one EOS
    ends = _ends(np.bincount(row, taken, len(sizes)).astype(np.int64) + 1)
    labels = np.full(ends[-1], n + most)
    labels[at[opens]] = sentinel[opens]
    labels[(at + opens)[m]] = own[m]
    parts = [_lists(_ends(np.bincount(row[kept], minlength=len(sizes))), pool.take(pa.array(inputs)), null), _lists(ends, pool.take(pa.array(labels)), null)]
    return pa.StructArray.from_arrays(parts, ["input_ids", "labels"], mask=pa.array(null))


def corrupt(ids: Column, mask: Column, first_sentinel: int = SENTINELS, eos: int = EOS, step: int = 1) -> Column:
    """STRUCT<input_ids, labels>: each masked run becomes a sentinel, in the labels followed by what it hides; then EOS. Arrow batches."""

    @F.arrow_udf(PAIR)
    def corrupted(i: pa.Array, m: pa.Array) -> pa.Array:
        return _corrupted(i, m, first_sentinel, eos, step)

    return corrupted(ids, mask)


def collate(blocks: DataFrame, input_length: int, target_length: int, mask: str = "mask", ids: str = "input_ids") -> DataFrame:
    """blocks with input_ids, attention_mask and labels of fixed lengths."""
    out = blocks.withColumn("_c", corrupt(F.col(ids), F.col(mask)))
    n = F.least(F.size("_c.input_ids"), F.lit(input_length))
    out = out.withColumn("attention_mask", F.transform(F.sequence(F.lit(1), F.lit(input_length)), lambda i: (i <= n).cast("int")))
    return out.withColumns({"input_ids": pad(F.col("_c.input_ids"), input_length), "labels": pad(F.col("_c.labels"), target_length)}).drop("_c", mask)


def _digests(key: str | None, ends: list[bytes]) -> list[bytes]:
    """md5 of key:end for each end; a null key is left out."""
    head = b"" if key is None else f"{key}:".encode()
    return [md5(head + e).digest() for e in ends]


def _luck(key: str | None, ends: list[bytes]) -> np.ndarray:
    """Numbers from 0 to below 1 that the key and each end (a place and a purpose) decide."""
    return np.frombuffer(b"".join([d[:4] for d in _digests(key, ends)]), ">u4") / float(1 << 32)


def _ends_of(n: int, what: str) -> list[bytes]:
    return [f"{i}:{what}".encode() for i in range(n)]


def poisson_steps(mean: float) -> list[float]:
    """Where the distribution function of span lengths stands after 0, 1, 2 and so on, until nothing is left to tell."""
    p, total, out = math.exp(-mean), 0.0, []
    while total + p < 1 - 2.0**-33:
        total += p
        out.append(total)
        p *= mean / len(out)
    return out


def _noise(length: int, key: str | None, density: float, steps: np.ndarray, mean_span: float, seed: int, starts: list[bytes]) -> np.ndarray:
    mask = np.zeros(length, bool)
    n = max(1, round(round(length * density) / mean_span))
    sizes = [k for k in np.searchsorted(steps, _luck(key, _ends_of(n, f"{seed}size")), "right").tolist() if k]
    room = max(1, length - sum(sizes))
    hashes = _digests(key, starts[:room])
    for k, p in zip(sizes, sorted(range(room), key=hashes.__getitem__)):
        mask[p : p + k] = True
    return mask


def noise_mask(length: Column, key: Column, density: float, mean_span: float, seed: int) -> Column:
    """About length * density masked positions in Poisson spans at random starts; key and seed decide. Arrow batches."""
    what = f"{seed}start"

    @F.arrow_udf("array<boolean>")
    def masks(lengths: pa.Array, keys: pa.Array) -> pa.Array:
        sizes = np.maximum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
        starts, steps = _ends_of(int(sizes.max(initial=1)), what), np.array(poisson_steps(mean_span))
        made = [_noise(n, k, density, steps, mean_span, seed, starts) if n else np.zeros(0, bool) for n, k in zip(sizes.tolist(), keys.to_pylist())]
        return _lists(_ends(sizes), pa.array(np.concatenate([*made, np.zeros(0, bool)])), np.asarray(lengths.is_null()))

    return masks(length.cast("int"), key.cast("string"))


def spread_mask(length: int, density: float, mean_span: float, seed: int) -> np.ndarray:
    """Of length * density masked positions, in spans that don't overlap or touch: gaps between them are drawn too."""
    rng = np.random.default_rng(seed)
    n_noise = min(length, max(1, int(np.round(length * density))))
    n_spans = max(1, min(int(np.round(n_noise / mean_span)), n_noise, length - n_noise + 1))
    cut = np.sort(rng.choice(n_noise - 1, n_spans - 1, replace=False)) + 1 if n_spans > 1 else np.empty(0, int)
    sizes = np.diff(np.concatenate([[0], cut, [n_noise]]))
    gaps = rng.multinomial(length - n_noise - (n_spans - 1), [1 / (n_spans + 1)] * (n_spans + 1))
    gaps[1:-1] += 1
    mask = np.zeros(length, bool)
    at = 0
    for gap, k in zip(gaps, sizes):
        mask[at + gap : at + gap + k] = True
        at += gap + k
    return mask


def with_noise(blocks: DataFrame, key: str = "block_id", density: float = 0.15, mean_span: float = 3.0, seed: int = 42, overlap: bool = True) -> DataFrame:
    """blocks with a mask that key and seed decide: spans by hashes, or, where spans may not overlap or touch, drawn with their gaps."""
    if overlap:
        return blocks.withColumn("mask", noise_mask(F.coalesce(F.size("input_ids"), F.lit(0)), F.col(key), density, mean_span, seed))

    @F.pandas_udf("array<boolean>")
    def masks(sizes: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([spread_mask(n, density, mean_span, (int(k) * 1_000_003 + seed) % 2**63).tolist() for n, k in zip(sizes, keys)])

    return blocks.withColumn("mask", masks(F.size("input_ids"), F.col(key).cast("long")))


def _masked(ids: pa.Array, keys: pa.Array, vocabulary: int, mask_id: int, special: list[int], p: float, seed: int) -> pa.Array:
    """masked_lm over one batch. Luck of a place is drawn where it counts: how, only for chosen ones."""
    null, sizes = np.asarray(ids.is_null()), _sizes(ids)
    tokens = ids.flatten().cast(pa.int32())
    there = np.asarray(tokens.is_valid())
    x = pc.fill_null(tokens, 0).to_numpy(zero_copy_only=False)
    out, ends, most = x.copy(), _ends(sizes), int(sizes.max(initial=0))
    chosen, plain = np.zeros(len(x), bool), there & ~np.isin(x, special)
    first, how, new = (_ends_of(most, f"{seed}{what}") for what in ("p", "how", "id"))
    for a, b, key in zip(ends[:-1].tolist(), ends[1:].tolist(), keys.to_pylist()):
        at = np.flatnonzero((_luck(key, first[: b - a]) < p) & plain[a:b])
        if len(at):
            chosen[a + at] = True
            h, places = _luck(key, [how[i] for i in at]), a + at
            out[places[h < 0.8]] = mask_id
            other = (h >= 0.8) & (h < 0.9)
            out[places[other]] = np.floor(_luck(key, [new[i] for i in at[other]]) * vocabulary).astype(np.int32)
    parts = [_lists(ends, pa.array(values, pa.int32(), mask=hidden), null) for values, hidden in ((out, ~there), (np.where(chosen, x, -100), np.zeros(len(x), bool)))]
    return pa.StructArray.from_arrays(parts, ["input_ids", "labels"])


def masked_lm(ids: Column, key: Column, vocabulary: int, mask_id: int, special: list[int], p: float = 0.15, seed: int = 42) -> Column:
    """STRUCT<input_ids, labels>: of p of the positions 80 % become the mask, 10 % a random id; other labels are -100. Arrow batches."""

    @F.arrow_udf(PAIR)
    def masked(i: pa.Array, k: pa.Array) -> pa.Array:
        return _masked(i, k, vocabulary, mask_id, special, p, seed)

    return masked(ids, key.cast("string"))
