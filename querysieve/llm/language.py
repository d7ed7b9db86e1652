"""Language identification by rank-order n-gram profiles.

Each language's profile is the list of its most frequent letter n-grams, most frequent first. A document gets the
same list of its own, and its distance to a profile is the sum over its n-grams of how far each stands out of place
(an n-gram that the profile lacks counts as the profile's length). The nearest language wins.

Texts are lower-cased, each run of other characters than letters is one blank, and n-grams of 1 to 3 are counted
over the whole text. Three 21-bit code points fit one 64-bit number, so any script is counted exactly.

Profiles are learned from every row that has a language and a text. A task sums what it reads and passes its sums on
when it holds HELD n-grams, so its memory is bounded whatever the scripts; of whole counts, only each task's first PROFILE go on.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, slices

ORDERS, PROFILE = 3, 400
#: Different n-grams of all languages whose counts a task holds before it passes them on.
HELD = 1 << 20
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as packed code points, and their counts; empty if it has no letter."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return none, none
    kept = np.concatenate([[0], np.where(letter, points, 0), [0]]).astype(np.int64)
    kept = kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])]  # one blank for each run
    codes = [kept[kept != 0]]
    gram = kept
    for _ in range(ORDERS - 1):
        gram = (gram[:-1] << 21) | kept[len(kept) - len(gram) + 1 :]
        codes.append(gram)
    codes = np.sort(np.concatenate(codes))
    codes = codes[np.searchsorted(codes, 1) :]
    edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[edges], np.diff(np.append(edges, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:most]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """language -> its ranked n-grams; PROFILE numbers for each. Rows without text or language teach nothing."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    names = [r[0] for r in labelled.select("lang").distinct().collect()]

    def rows(sums):
        for k, (codes, m) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(codes), pa.string()), pa.array(codes), pa.array(m)], ["lang", "code", "n"])

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, 500):
            by: dict[str, list] = {}
            for k, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(k, []).append(gram_counts(t))
            for k, found in by.items():
                found += [sums[k]] if k in sums else []
                codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                sums[k] = codes, np.bincount(inverse, np.concatenate([m for _, m in found]), len(codes)).astype(np.int64)
            if sum(len(codes) for codes, _ in sums.values()) >= HELD:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    def first(batches):
        """Of whole counts, a task's PROFILE most frequent codes of each language: the others can't be among all tasks' first."""
        tops: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, 50_000):
            of = b.column("lang").dictionary_encode()
            for i, k in enumerate(of.dictionary.to_pylist()):
                own = np.flatnonzero(of.indices.to_numpy() == i)
                codes, m = (b.column(c).to_numpy()[own] for c in ("code", "n"))
                if k in tops:
                    codes, m = np.concatenate([tops[k][0], codes]), np.concatenate([tops[k][1], m])
                order = np.lexsort((codes, -m))[:PROFILE]
                tops[k] = codes[order], m[order]
        yield from rows(tops)

    schema = "lang string, code long, n long"
    counts = labelled.mapInArrow(count, schema).groupBy("lang", "code").agg(F.sum("n").alias("n")).mapInArrow(first, schema)
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))), 1, PROFILE)
    kept = counts.groupBy("lang", (F.col("code") % 64).alias("part")).agg(best.alias("best"))
    found: dict[str, list] = {k: [] for k in names}
    for r in kept.collect():  # 64 parts of at most PROFILE for each language
        found[r["lang"]] += [(x["m"], x["code"]) for x in r["best"]]
    return {k: [code for _, code in sorted(v)[:PROFILE]] for k, v in sorted(found.items())}


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the nearest language and a score from 0 to 1 (1: every n-gram in place); und and 0 without letters.

    Only the text decides. Ties go to the first language in alphabetical order.
    """
    names = [k for k, v in profiles.items() if v]
    vocabulary = np.unique(np.array([c for k in names for c in profiles[k]], np.int64))
    places = np.full((len(vocabulary) + 1, len(names)), -1, np.int32)
    for j, k in enumerate(names):
        places[np.searchsorted(vocabulary, np.array(profiles[k], np.int64)), j] = np.arange(len(profiles[k]))
    fields = [c for c in docs.columns if c not in (lang_pred, score)]
    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in fields) + f", `{lang_pred}` string, `{score}` double"

    def one(t: str | None) -> tuple[str, float]:
        own = ranked(*gram_counts(t))
        if not len(own) or not names:
            return UNKNOWN, 0.0
        at = np.searchsorted(vocabulary, own)
        at[vocabulary[np.minimum(at, len(vocabulary) - 1)] != own] = len(vocabulary)
        theirs = places[at]
        away = np.where(theirs < 0, PROFILE, np.minimum(PROFILE, np.abs(theirs - np.arange(len(own))[:, None])))
        distance = away.sum(axis=0) / (PROFILE * len(own))
        j = int(np.argmin(distance))
        return names[j], float(1 - distance[j])

    def run(batches):
        for b in slices(batches, 1000):
            found = [one(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in fields), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*fields, lang_pred, score]
            )

    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame, key: str = "doc_id", folds: int = 4, held: int = 2) -> Column:
    return F.coalesce(crc_bucket(key, folds) != held, F.lit(True))


def held_out_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the other folds' labelled rows, predicted for all."""
    train = training_rows(docs)
    return predict(docs.select("doc_id", (~train).alias("held_out"), "text"), learn(docs.where(train))).drop("text")
