"""Line dedup by a log-template tree.

Lines are parsed as a log parser does, and so that no line's place depends on the others' order. The tree has a fixed
depth: the first level is the number of tokens, the next LEADING levels are the first tokens, where a token with a digit
counts as a variable. At a leaf, a token is part of a template if it stands at its position in `least` lines or more;
what stands elsewhere is a variable field. A line of which that leaves less than ALIKE of the tokens (or fewer than
CONSTANT) belongs to no template. A template that occurs in at least `least` documents recurs: its lines (licence lines,
notices, menus) are dropped, but for the first document that holds it. Words of scripts without spaces are parsed
character by character.

A line of fewer than TOKENS tokens is too short for a template. With `short` it recurs if the same line, digits and
all, stands in `least` documents. With `long_least` a line of more than LONG tokens recurs, too, if the same line stands
in that many documents. Both are told apart by a digest of the line and move no text.

How it is spread out: leaves are counted first (a number each), and only lines of leaves in enough documents go on.
These are summed by masked line before any shuffle of lines, so that a frequent line is one row a task. Tokens are
counted by leaf and position, so a leaf of very many lines is dealt by its tokens. What comes back to the documents is a
key for each line, and to their texts the digests of the lines to drop: up to MOST of them go to every task, and no text moves.
More are joined by document, with the positions to drop.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, slices

LEADING, ALIKE, CONSTANT = 3, 0.6, 2
#: Documents that make a template recurring; tokens of the shortest line considered.
LEAST, TOKENS = 10, 5
#: Tokens that a long line has more than, and the documents that make it recurring where it stands unchanged.
LONG, LONG_LEAST = 50, 2
#: Stands for a variable field.
ANY = "<*>"
#: Slots of the filters, of leaves and of documents, that spare most rows a shuffle; they bound what is broadcast and decide no result.
SLOTS, DOC_SLOTS = 1 << 22, 1 << 20
#: Different lines to drop that every task may be sent: 8 bytes each.
MOST = 1 << 21
_DIGIT = re.compile(r"\d")
#: Thai, Lao, Myanmar, Khmer, kana, CJK and their extensions.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def tokens_of(line: str) -> list[str]:
    """Tokens, those with a digit made variable."""
    tokens = (_UNSPACED.sub(r" \g<0> ", line) if _UNSPACED.search(line) else line).split()
    return [ANY if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def leaf_of(tokens: list[str]) -> int:
    return _key(f"{len(tokens)} {' '.join(tokens[:LEADING])}")


def _lines(text: str | None) -> list[tuple[int, list[str]]]:
    """Positions and tokens of the lines that are considered."""
    if not text:
        return []
    split = ((i, tokens_of(x)) for i, x in enumerate(text.split("\n")) if len(x) >= 2 * TOKENS - 1)
    return [(i, t) for i, t in split if len(t) >= TOKENS]


def _entries(text: str | None, least: int, short: bool, long_least: int | None) -> list[tuple[int, str, int, int]]:
    """Position, masked line, leaf and the documents that make it recurring; a line that counts unchanged has its digest for both."""
    parsed = _lines(text)
    out = [(i, " ".join(t), leaf_of(t), least) for i, t in parsed]
    if text and (short or long_least is not None):
        sizes = {i: len(t) for i, t in parsed}
        for i, x in enumerate(text.split("\n")):
            n = sizes.get(i, 0)
            need = long_least if n > LONG else least if short and not n else None
            if need is not None and (words := x.split()):
                m = "=" + xxhash.xxh3_128_hexdigest(" ".join(words).encode("utf-8", "surrogatepass"))
                out.append((i, m, _key(m), need))
    return out


def _slots(keys: DataFrame, column: str) -> np.ndarray:
    """Which of SLOTS slots hold a key, as bits: at most SLOTS / 64 numbers are gathered."""
    slot = F.pmod(column, F.lit(SLOTS))
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({column}, {SLOTS}) & 63 as int)))").alias("bits")).toPandas()
    out = np.zeros(SLOTS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def templates_of(lines: DataFrame, least: int) -> DataFrame:
    """line, template of distinct masked lines (leaf, line, masked, n: places); lines without a template are left out."""
    tokens = lines.where(~F.col("masked").startswith("=")).select("leaf", "line", "n", F.posexplode(F.split("masked", " ")).alias("pos", "token"))
    often = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("c")).where(F.col("c") >= least).drop("c")
    kept = tokens.join(often.withColumn("in", F.lit(True)), ["leaf", "pos", "token"], "left")
    word, inside = F.col("token") != ANY, F.col("in").isNotNull()
    parsed = kept.groupBy("leaf", "line").agg(
        F.bit_xor(F.when(inside, F.xxhash64("pos", "token"))).alias("x"), F.count_if(inside).alias("m"), F.count_if(inside & word).alias("constant"), F.count("*").alias("size")
    ).where((F.col("m") >= ALIKE * F.col("size")) & (F.col("constant") >= CONSTANT))
    same = lines.where(F.col("masked").startswith("=")).select("line", F.col("line").alias("template"))
    return parsed.select("line", F.xxhash64("leaf", "x", "m").alias("template")).unionByName(same)


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, short: bool = False, long_least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """k (key), t (hash of the text), pos, raw (hash of the line) and template of lines that recur; and the first place (k, t, pos) of each template, which stays."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("x"))
    kind = dict(rows.dtypes)["k"]

    def count(batches):
        n: dict[tuple[int, int], int] = {}

        def counted():
            leaves, needs = zip(*n)
            return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(needs, pa.int32()), pa.array(n.values(), pa.int64())], ["leaf", "need", "n"])

        for b in slices(batches, 1000):
            for x in b.column(1).to_pylist():
                for leaf in {(leaf, need) for _, _, leaf, need in _entries(x, least, short, long_least)}:
                    n[leaf] = n.get(leaf, 0) + 1
            if len(n) > 150_000:
                yield counted()
                n = {}
        if n:
            yield counted()

    busy = rows.mapInArrow(count, "leaf long, need int, n long").groupBy("leaf", "need").agg(F.sum("n").alias("n")).where(F.col("n") >= F.col("need"))
    some = spark.sparkContext.broadcast(_slots(busy, "leaf"))  # SLOTS bits

    def considered(batches):
        """Lines of busy leaves, once for each task and masked line with its text, and where each stands."""
        bits, seen = some.value, set()
        for b in slices(batches, 1000):
            out: list[list] = [[], [], [], [], [], [], [], []]
            for i, x in enumerate(b.column(1).to_pylist()):
                found = [e for e in _entries(x, least, short, long_least) if bits[(slot := e[2] % SLOTS) >> 6] >> (slot & 63) & 1]
                if found:
                    digest, raw = _key(x), x.split("\n")
                for p, m, leaf, need in found:
                    line = _key(m)
                    if new := line not in seen:
                        if len(seen) > 150_000:
                            seen.clear()
                        seen.add(line)
                    for column, value in zip(out, (i, digest, p, line, leaf, need, m if new else None, _key(raw[p]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(columns[0]), *columns[1:]], ["k", "t", "pos", "line", "leaf", "need", "masked", "raw"])

    stands = cut(rows.mapInArrow(considered, f"k {kind}, t long, pos int, line long, leaf long, need int, masked string, raw long"))
    lines = cut(stands.groupBy("leaf", "line").agg(F.max("masked").alias("masked"), F.count("*").alias("n")))
    named = templates_of(lines, least)
    placed = cut(stands.select("k", "t", "pos", "line", "need", "raw").join(named, "line").select("k", "t", "pos", "template", "need", "raw"))
    release(stands)
    # documents of each template, and its first place
    each = placed.groupBy("template", "k", "t").agg(F.min("pos").alias("pos"), F.min("need").alias("need"))
    often = cut(each.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("k", "pos", "t")).alias("first"), F.min("need").alias("_need")).where(F.col("n") >= F.col("_need")).drop("_need"))
    return placed.join(often.select("template"), "template").select("k", "t", "pos", "raw", "template"), often.select("template", "first.k", "first.t", "first.pos")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, short: bool = False, long_least: int | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the text without lines of recurring templates, and two columns named by counts: its lines, and those dropped.

    A null text stays null (0 lines); an empty one has one empty line. A text all of whose lines go becomes empty.
    Each template keeps its first line, whatever else it is: of the least key, there the least position (a null key comes first). Repeated rows
    are treated alike. Columns that have the names of counts are replaced by them; no other column's name matters.
    """
    found, firsts = recurring_lines(docs, key, text, least, short, long_least)
    lines = cut(found.select("raw").distinct())
    columns = [c for c in docs.columns if c not in counts]
    if lines.count() <= MOST:
        return _dropped(docs, columns, key, text, lines, firsts, counts)
    drops = cut(found.join(firsts.select(F.col("k").alias("k1"), F.col("t").alias("d1"), F.col("pos").alias("p1")).distinct(), F.col("k").eqNullSafe(F.col("k1")) & (F.col("t") == F.col("d1")) & (F.col("pos") == F.col("p1")), "left_anti").groupBy("k", "t").agg(F.collect_set("pos").alias("drops")))
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(DOC_SLOTS)).cast("int")
    hit = F.broadcast(drops.select(slot("k").alias("slot")).distinct())  # at most DOC_SLOTS numbers
    rows = docs.select(F.struct(*columns).alias("r"), F.col(key).alias("k"), F.col(text).alias("x")).withColumn("slot", slot("k"))
    kinds = {c: dict(rows.dtypes)[c] for c in ("r", "k")}

    def digests(batches):
        for b in slices(batches, 1000):
            t = pa.array([None if x is None else _key(x) for x in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), t], ["r", "k", "x", "t"])

    touched = rows.join(hit, "slot", "left_semi").select("r", "k", "x").mapInArrow(digests, f"r {kinds['r']}, k {kinds['k']}, x string, t long")
    others = rows.join(hit, "slot", "left_anti").select("r", "x", F.lit(None).cast("array<int>").alias("drops"))
    drops = drops.select(F.col("k").alias("k2"), F.col("t").alias("t2"), "drops")
    touched = touched.join(drops, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left").select("r", "x", "drops")
    both = touched.unionByName(others).withColumn("lines", F.split("x", "\n", -1))
    left = F.when(F.col("drops").isNull(), F.col("x")).otherwise(F.array_join(F.filter("lines", lambda _, i: ~F.array_contains("drops", i)), "\n"))
    return both.select(
        *[left.alias(c) if c == text else F.col("r")[c].alias(c) for c in columns],
        F.when(F.col("x").isNull(), 0).otherwise(F.size("lines")).alias(counts[0]),
        F.coalesce(F.when(F.col("drops").isNotNull(), F.size("drops")), F.lit(0)).alias(counts[1]),
    )


def _place(k, t: int, pos: int) -> int:
    return _key(f"{k}\n{t}\n{pos}")


def _dropped(docs: DataFrame, columns: list[str], key: str, text: str, lines: DataFrame, firsts: DataFrame, counts: tuple[str, str]) -> DataFrame:
    """docs without the given lines (hashes), but for first places; one pass over the documents, and no join."""
    kept = np.sort(np.array([_place(r["k"], r["t"], r["pos"]) for r in firsts.select("k", "t", "pos").toLocalIterator()], np.int64))  # no more than lines
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(lines.toPandas()["raw"].to_numpy(np.int64)), kept))
    rows = docs.select(F.struct(*columns).alias("r"), F.col(key).alias("k"), F.col(text).alias("x"))
    kind = dict(rows.dtypes)["r"]

    def has(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)

    def run(batches):
        drop, stay = shared.value
        for b in slices(batches, 1000):
            texts = b.column(2).to_pylist()
            each = [[] if x is None else x.split("\n") for x in texts]
            hit = has(drop, np.array([_key(x) for own in each for x in own], np.int64))
            gone, at = [0] * len(texts), 0
            for i, own in enumerate(each):
                here = np.flatnonzero(hit[at : at + len(own)]).tolist()
                at += len(own)
                if here:
                    t, k = _key(texts[i]), b.column(1)[i].as_py()
                    out = {p for p in here if not has(stay, np.array([_place(k, t, p)], np.int64))[0]}
                    if out:
                        texts[i], gone[i] = "\n".join(x for p, x in enumerate(own) if p not in out), len(out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(own) for own in each], pa.int32()), pa.array(gone, pa.int32())], ["r", "x", "n", "gone"])

    found = rows.mapInArrow(run, f"r {kind}, x string, n int, gone int")
    return found.select(*[F.col("x").alias(c) if c == text else F.col("r")[c].alias(c) for c in columns], F.col("n").alias(counts[0]), F.col("gone").alias(counts[1]))
