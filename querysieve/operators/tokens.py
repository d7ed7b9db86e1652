"""Tokenizers and block packing."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querysieve.functions.detect import once
from querysieve.sources.io import settle

from .order import id_bucket, running_total

PAD, EOS, UNKNOWN = 0, 1, 2


def _int_lists(rows: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *[np.asarray(r, np.int32) for r in rows]])))


def _texts(texts: pa.Array) -> list[str]:
    return pc.fill_null(texts, "").to_pylist()


class Tokenizer(Protocol):
    """What a tokenizer gives: the ids of a text column, and the text of an id column."""

    vocabulary: int

    def ids(self, text: Column) -> Column: ...

    def text(self, ids: Column) -> Column: ...


@dataclass(frozen=True)
class WordTokenizer:
    """Words between ASCII white space; an id is three plus a hash below the vocabulary's size. Native expressions."""

    vocabulary: int = 32_000
    pattern: str = r"[^ \t\r\n]+"

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)

    def ids(self, text: Column) -> Column:
        return F.transform(self.words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % (self.vocabulary - 3) + 3).cast("int"))

    def text(self, ids: Column) -> Column:
        """Ids of this tokenizer have no way back; they are shown as numbers, special ones left out."""
        return F.array_join(F.transform(F.filter(ids, lambda i: i > UNKNOWN), lambda i: i.cast("string")), " ")


@dataclass(frozen=True)
class SurfaceTokenizer:
    """Tokens are the words themselves (ARRAY<STRING>): blocks of them decode to readable text without a vocabulary."""

    vocabulary: int = 0
    pattern: str = r"[^ \t\r\n]+"

    def ids(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)

    def text(self, ids: Column) -> Column:
        return F.array_join(ids, " ")


@dataclass(frozen=True)
class TableTokenizer:
    """Words looked up in a fixed list of at most `most` entries; others are UNKNOWN. Decodes."""

    entries: tuple[str, ...]
    pattern: str = r"[^ \t\r\n]+"
    most: int = 100_000

    def __post_init__(self):
        if len(self.entries) > self.most:
            raise ValueError("the list is too long to be a constant; use a file-backed tokenizer")

    @property
    def vocabulary(self) -> int:
        return len(self.entries) + 3

    def ids(self, text: Column) -> Column:
        table = F.array(*map(F.lit, self.entries))
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)
        return F.transform(words, lambda w: F.when(F.array_position(table, w) > 0, F.array_position(table, w) + 2).otherwise(UNKNOWN).cast("int"))

    def text(self, ids: Column) -> Column:
        table = F.array(*map(F.lit, self.entries))
        return F.array_join(F.transform(F.filter(ids, lambda i: i > UNKNOWN), lambda i: F.try_element_at(table, i - 2)), " ")


@dataclass(frozen=True)
class FileTokenizer:
    """A tokenizers (JSON) or sentencepiece (model) file that every executor can read; Arrow batches, loaded once a worker."""

    path: str
    vocabulary: int

    @classmethod
    def of(cls, path: str) -> "FileTokenizer":
        """With the vocabulary's size that the file gives."""
        if path.endswith(".model"):
            import sentencepiece

            return cls(path, sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size())
        import tokenizers

        return cls(path, tokenizers.Tokenizer.from_file(path).get_vocab_size())

    @cached_property
    def _load(self):
        if self.path.endswith(".model"):
            import sentencepiece

            tool = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return (lambda ts: tool.encode(ts, num_threads=1)), (lambda xs: [tool.decode(x) for x in xs])
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import tokenizers

        tool = tokenizers.Tokenizer.from_file(self.path)
        made = json.loads(tool.to_str())
        encode = lambda ts: [e.ids for e in tool.encode_batch_fast(ts, add_special_tokens=False)]
        return (_by_words(tool, made, encode) if _splits(made) else encode), (_by_bytes(tool, made) if (made["decoder"] or {}).get("type") == "ByteLevel" else tool.decode_batch)

    @classmethod
    @cache
    def _tool(cls, path: str, vocabulary: int) -> "FileTokenizer":
        """The one of a worker, loaded once."""
        return cls(path, vocabulary)

    def ids(self, text: Column) -> Column:
        path, vocabulary = self.path, self.vocabulary

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            return _int_lists(FileTokenizer._tool(path, vocabulary)._load[0](_texts(texts)))

        return encode(text)

    def text(self, ids: Column) -> Column:
        path, vocabulary = self.path, self.vocabulary

        @F.arrow_udf("string")
        def decode(lists: pa.Array) -> pa.Array:
            return pa.array(FileTokenizer._tool(path, vocabulary)._load[1]([x or [] for x in lists.to_pylist()]), pa.string())

        return decode(ids)


def _splits(made: dict) -> bool:
    """Whether a tokenizer is byte-level BPE whose pattern never joins a character to white space after it, and has no other steps."""
    pre, model = made["pre_tokenizer"] or {}, made["model"]
    plain = not any(made[k] for k in ("normalizer", "truncation", "padding"))
    return plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and model.get("type") == "BPE" and not model.get("dropout")


#: White space by some table or other, besides blanks, tabs and ends of lines: where it stands, only the library tells what is one run.
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: Parts that a worker keeps the ids of, about: twice so many of some 200 bytes.
_MOST = 1 << 18
_WORD = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")


def _by_words(tool, made: dict, encode):
    """encode by white space and the word after it: pieces end before white space, so each such part has ids of its own. Equal to the library."""
    added = [x["content"] for x in made["added_tokens"]]
    known, before = {}, {}  # ids of parts as bytes: those met lately, and those met before them

    def packed(texts: list[str]) -> list[bytes]:
        return [np.array(ids, np.int32).tobytes() for ids in encode(texts)]

    def parts(texts: list[str]) -> list[np.ndarray]:
        nonlocal known, before
        whole = [i for i, t in enumerate(texts) if _RARE.search(t) or any(x in t for x in added)]
        out = dict(zip(whole, packed([texts[i] for i in whole])))
        split = [[] if i in out else _WORD.findall(t) for i, t in enumerate(texts)]
        if len(known) > _MOST:
            known, before = {}, known
        new = set(chain.from_iterable(split)).difference(known)
        known.update({w: before[w] for w in new if w in before})
        new = list(new.difference(before))
        known.update(zip(new, packed(new)))
        return [np.frombuffer(out[i] if i in out else b"".join(map(known.__getitem__, words)), np.int32) for i, words in enumerate(split)]

    return parts


def _by_bytes(tool, made: dict):
    """decode by the bytes of each id; the library decodes what has special ids, or bytes that are no UTF-8."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {x["id"] for x in made["added_tokens"]}
    table = {i: bytes(byte[c] for c in w) for w, i in tool.get_vocab().items() if i not in added and all(c in byte for c in w)}

    def one(ids: list[int]) -> str:
        try:
            return b"".join(map(table.__getitem__, ids)).decode()
        except (KeyError, UnicodeDecodeError):
            return tool.decode(ids)

    return lambda lists: list(map(one, lists))


def tokenize(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", add_eos: bool = False) -> DataFrame:
    """key, input_ids, attention_mask. add_eos: each document ends with EOS (the batch path), or not (the stream)."""
    ids = tokenizer.ids(F.col(text))
    ids = F.concat(ids, F.array(F.lit(EOS))) if add_eos else ids
    ids = once(ids)
    return docs.select(key, ids.alias("input_ids")).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def _cut(pieces: DataFrame, size: int, short: Column | None, group: list[str]) -> DataFrame:
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]))
    blocks = pieces.groupBy(*group, "block_id").agg(joined.alias("input_ids"))
    full = F.size("input_ids") == size
    return blocks.where(full | short if short is not None else full)


def _placed(tokens: DataFrame, key: str) -> DataFrame:
    """Tokens with their place in the stream. They are made once and written; places come from key and count alone."""
    own = settle(tokens.select(key, "input_ids", F.size("input_ids").cast("long").alias("_n")))
    return running_total(own, id_bucket(key), [key], F.col("_n"), "start").drop("_n")


def _pieces(placed: DataFrame, size: int, *extra: str) -> DataFrame:
    """Each document's part of each block that it reaches into; tokens are cut out of arrays, never exploded."""
    n = F.size("input_ids")
    blocks = F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(start + size(input_ids) - 1) div {size}")))
    spread = placed.where(n > 0).select("start", "input_ids", *extra, blocks.alias("block_id"))
    lo = F.greatest(F.col("block_id") * size, F.col("start"))
    hi = F.least((F.col("block_id") + 1) * size, F.col("start") + n)
    return spread.select(*extra, "block_id", "start", F.slice("input_ids", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


def pack(tokens: DataFrame, size: int = 512, key: str = "doc_id") -> DataFrame:
    """block_id, input_ids, attention_mask: the token stream in the order of key, cut into blocks; a short tail goes."""
    return _cut(_pieces(_placed(tokens, key), size), size, None, []).withColumn("attention_mask", F.array_repeat(F.lit(1), size))


def pack_all(tokens: DataFrame, size: int = 512, key: str = "doc_id") -> DataFrame:
    """As pack, with the short tail."""
    return _cut(_pieces(_placed(tokens, key), size), size, F.lit(True), []).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def pack_per_batch(tokens: DataFrame, size: int = 512, batch: int = 1000, key: str = "doc_id", rows: str | None = None) -> DataFrame:
    """As pack, but streams end with each batch of rows: every batch loses its tail, or is one short block if that is all.

    rows: a column with row numbers from 0; key itself if it has them.
    """
    base = tokens.select(key, "input_ids", F.floor(F.col(rows or key) / batch).alias("batch"))
    before = F.coalesce(F.sum(F.size("input_ids").cast("long")).over(W.partitionBy("batch").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = _cut(_pieces(base.withColumn("start", before), size, "batch"), size, F.col("block_id") == 0, ["batch"])
    return blocks.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def stats(df: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """n_samples, n_tokens of packed or tokenized rows (input_ids), else of texts."""
    if "input_ids" in df.columns:
        n = F.size("input_ids")
    elif "text" in df.columns and tokenizer:
        n = F.size(tokenizer.ids(F.col("text")))
    else:
        raise ValueError("neither input_ids nor text with a tokenizer")
    return df.agg(F.count("*").alias("n_samples"), F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("n_tokens"))


def truncated(context: Column, query: Column, tokenizer: WordTokenizer, most: int = 512, spare: int = 10) -> Column:
    """The context, cut to what the query leaves of a token budget if both don't fit."""
    c, q = tokenizer.words(context), tokenizer.words(query)
    room = F.greatest(F.lit(0), most - F.size(q) - spare)
    return F.when(F.size(c) + F.size(q) > most, F.array_join(F.slice(c, 1, room), " ")).otherwise(context)


def pad(ids: Column, length: int, by: int = PAD) -> Column:
    """Cut or filled up to a fixed length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(by), length)), 1, length)


def in_range(ids: Column, vocabulary: int) -> Column:
    """Whether ids are a sample a model takes: all below the vocabulary's size, none negative, not all zero."""
    return (F.array_min(ids) >= 0) & (F.array_max(ids) < vocabulary) & (F.array_max(ids) > 0)
