"""Byte-level BPE encoding and decoding with a public vocabulary.

Each pre-token is merged with a contiguous rank array: the word's part
boundaries and the ranks of its adjacent pairs sit in two flat lists; the
smallest rank is found by a scan, its boundary is deleted, and the two
neighbouring ranks are looked up anew. Words of over `LONG` bytes use a heap
over the same ranks, so a megabyte without white space stays n log n.
Merged words are remembered per Python worker in a bounded table.

Defined cases: NULL text is empty text (no ids, empty decoding); an empty
table gives an empty table; repeated rows give repeated results; extra columns
are not read. The special token's string in a text is the special token, as in
the tokenizers library. Every row is encoded in full.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 128
REMEMBERED = 200_000
NO_RANK = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte: printable Latin-1 bytes stand for
    themselves, the rest for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Ranks and byte strings of one vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of_byte = [0] * 256
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            self.bytes_of[i] = bytes(letters[c] for c in token)
            if len(token) == 1:
                self.id_of_byte[letters[token]] = i
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.made.append(vocab[a + b])
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge_short(self, parts: list[int]) -> list[int]:
        """Rank array over one word: scan, delete a boundary, refresh two ranks."""
        rank, made = self.rank.get, self.made
        ranks = [rank(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NO_RANK)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order from a heap and neighbour links."""
        n = len(parts)
        left, right, rank = list(range(-1, n - 1)), list(range(1, n + 1)), self.rank.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank((a, b), NO_RANK)) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], right[i] = self.made[r], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] < n:
                    pair = (parts[x], parts[right[x]])
                    if (q := rank(pair, NO_RANK)) < NO_RANK:
                        heapq.heappush(heap, (q, x, *pair))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.known.get(word)
        if ids is None:
            data = word.encode("utf-8", "surrogatepass")
            parts = [self.id_of_byte[b] for b in data]
            ids = tuple(self.merge_short(parts) if len(parts) <= LONG else self.merge_long(parts))
            if len(word) <= LONG:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.word, self.find(text))))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        out: list[int] = []
        for i, piece in enumerate(self.cut.split(text)):
            out += [self.special[piece]] if i % 2 else self.plain(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               vocab: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    return _run(docs, id_col, text_col, vocab, decode=False)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   vocab: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): encode, then decode the ids."""
    return _run(docs, id_col, text_col, vocab, decode=True)


def bpe_decode(table: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
               vocab: str | None = None) -> DataFrame:
    """(doc_id, decoded string) of arrays of ids; a NULL array is an empty one."""
    from .common import col
    name = vocab or "byte_bpe_50k.json"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name if "/" in name else vocabulary(name))
        for b in batches:
            out = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "decoded"])

    return table.select(col(id_col).cast("long").alias("doc_id"), col(ids_col).cast("array<int>").alias("ids")) \
        .mapInArrow(decode, "doc_id long, decoded string")


def _run(docs: DataFrame, id_col: str, text_col: str, vocab: str | None, decode: bool) -> DataFrame:
    name = vocab or "byte_bpe_50k.json"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name if "/" in name else vocabulary(name))  # the file is found on the executor
        for b in slices(batches, most=4 << 20):
            ids = [c.encode(t) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
            if decode:
                cols.append(pa.array([c.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][:len(cols)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * decode
    return texts(docs, id_col, text_col).mapInArrow(encode, schema)


def sha256_of_ids(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)
