"""SentencePiece encoding and decoding by a merge-type prefix table.

A merge (BPE) encoding has the property that each prefix of a text has one encoding and that two neighbouring
tokens of a valid encoding are themselves what their joined text encodes to. So one value a prefix is enough: its
unique last token. The automaton lists the vocabulary entries that end at a position; the one whose predecessor
(the last token of the prefix before it) is pair-compatible with it is the answer. The ids are then read off
backwards. Time is linear in the text for a vocabulary of bounded entry length.

Texts are cut where no entry can reach across: before a space that follows something else, and around characters
that occur in no entry (those become byte tokens). Cuts only bound the length of one table and let workers reuse
the ids of a piece that they have seen.

Null or empty text: no ids, decoded text empty. Extra columns are left alone.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import give_back, slices

SPACE = "▁"
#: Encoded parts and pairs of tokens that a worker keeps before it starts afresh: about 60 MB each.
KEPT, PAIRS = 300_000, 500_000


class PieceCodec:
    """Encoder and decoder over the vocabulary of a SentencePiece model of type BPE with byte fallback."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())]
        names = [sp.id_to_piece(i) for i in range(len(special))]
        self.ids = {p: i for i, (p, s) in enumerate(zip(names, special)) if not s}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("an entry spans words; texts can't be cut at spaces")
        if sp.normalize(" a\t  b") != f"{SPACE}{SPACE}a\t{SPACE}{SPACE}b":
            raise ValueError("only the identity normaliser with a leading space is supported")
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.letters = {c for p in self.ids for c in p}
        self.bytes_of = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.bytes_of[sp.unk_id()] = " ⁇ ".encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.decimal = [str(i) for i in range(len(names))]
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and self.merged(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.table: dict[str, bytes] = {}
        alone = "".join({"\n", "\t"} - self.letters)  # frequent characters that no entry has
        self.cutter = re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+")

    def merged(self, text: str) -> list[str]:
        """The definition, for short texts: join the best-scored neighbours, leftmost first, until none can be."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """The encoding of a text, as entries and single characters."""
        last: list[str] = list(text)  # where no entry will do it is the character alone: a prefix has one last token
        pairs, done = self.pairs, -1
        for end, p in self.automaton.iter(text):
            if end != done:
                start = end - len(p)
                if start < 0:
                    last[end], done = p, end
                else:
                    left = last[start]
                    fits = pairs.get((left, p))
                    if fits is None:
                        fits = self.compatible(left, p)
                    if fits:
                        last[end], done = p, end
        out, end = [], len(text) - 1
        while end >= 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _piece_ids(self, text: str) -> list[int]:
        known = self.ids
        try:
            return [known[p] for p in self.pieces(text)]
        except KeyError:
            return [i for p in self.pieces(text) for i in ([known[p]] if p in known else [self.byte_ids[b] for b in p.encode()])]

    def cut_ids(self, part: str) -> bytes:
        """int32 ids of a part between cuts."""
        if self.letters.issuperset(part):
            return array("i", self._piece_ids(part)).tobytes()
        out: list[int] = []
        run = ""
        for c in part:
            if c in self.letters:
                run += c
            else:
                out += self._piece_ids(run) if run else []
                run = ""
                out += [self.byte_ids[b] for b in c.encode()]
        out += self._piece_ids(run) if run else []
        return array("i", out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        table, found = self.table, []
        for part in self.cutter.findall(SPACE + text.replace(" ", SPACE)):
            ids = table.get(part)
            if ids is None:
                ids = self.cut_ids(part)
                if len(part) <= 64:
                    if len(table) >= KEPT:
                        table.clear()
                    table[part] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids) -> str:
        """Text of ids; the space that encoding puts first goes, ill-formed byte runs become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")

    def forget(self) -> None:
        """At a task's end: only the vocabulary stays."""
        self.table.clear()
        self.pairs.clear()
        give_back()


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def encode(docs: DataFrame, model_file: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with an ARRAY<INT> column of token ids. A map over rows: no shuffle, and memory for one batch of 256."""
    fields = [c for c in docs.columns if c != into]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != into) + f", `{into}` array<int>"

    def run(batches):
        tool = codec(model_file)
        for b in slices(batches, 256):
            ids = [tool.encode(t) for t in b.column(text).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.ListArray.from_arrays(offsets, pa.array(values))], [*fields, into])
        tool.forget()

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_file: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens with the text of their ids (null ids: empty)."""
    fields = [c for c in tokens.columns if c != into]
    schema = ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes if c != into) + f", `{into}` string"

    def run(batches):
        tool = codec(model_file)
        for b in slices(batches, 256):
            column = b.column(ids)
            offsets, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
            texts = ["" if null else tool.decode(values[i:j].tolist()) for i, j, null in zip(offsets, offsets[1:], column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in fields), pa.array(texts, pa.string())], [*fields, into])

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded and decoded in one pass, one vocabulary a worker."""

    def run(batches):
        tool = codec(model_file)
        for b in slices(batches, 256):
            sizes, coded, decoded = [], [], []
            for t in b.column(1):
                ids = tool.encode(t.as_py()).tolist()
                sizes.append(len(ids))
                coded.append(sha256(",".join(map(tool.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        tool.forget()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
