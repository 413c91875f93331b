"""Byte-level BPE: encoding and decoding, exact and in linear time.

Bytes are mapped to Latin-1 characters so that the trie of an automaton finds the longest
vocabulary entry from a position on. From the left the longest entry is taken that is compatible with the
token before it (pairs are memoised); where none fits, the last token is given up for its next
shorter one. A position given up is never tried again, as the tokens of a prefix are unique, so
each position is entered once.

Nulls and empty texts have no token and decode to no byte. Rows are independent: ties, repeated
rows and empty tables need no rule, and further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import CACHES, blocks, forget_late, map_arrow, strings
from vespera.llm.merges import Merges


class Codec(dict):
    """piece of text -> its ids as decimal numbers with one space between: a cache, at most `most` pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 200_000):
        super().__init__()
        rank = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.names = {t: str(i) for t, i in rank.items()}
        self.bytes_of = {str(i): t for t, i in ranks.items()}
        self.merges, self.most = Merges(rank), most
        self.automaton = ahocorasick.Automaton()
        tokens = {t for t in rank if self.merges.reachable(t)}
        self.inside: dict[str, str | None] = {"": None}  # of each path of the trie: the longest token that begins it
        for token in sorted(tokens, key=len):
            self.automaton.add_word(token, len(token))
            for n in range(1, len(token) + 1):
                path = token[:n]
                if path not in self.inside:
                    self.inside[path] = path if path in tokens else self.inside[path[:-1]]
        self.shorter = {t: self.inside[t[:-1]] for t in tokens}
        self.longest = max(map(len, tokens))
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> str:
        if len(self) > self.most:
            forget_late(self)
        out = self.encode_piece(piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1"))
        if len(piece) < 1000:
            self[piece] = out
        return out

    def encode_piece(self, s: str) -> str:
        """s: the piece's bytes as Latin-1."""
        names = self.names
        return names.get(s) or " ".join([names[t] for t in self.backtrack(s)])

    def backtrack(self, s: str) -> list[str]:
        inside, shorter, reach, width, size = self.inside, self.shorter, self.automaton.longest_prefix, self.longest, len(s)
        known, compatible = self.merges.known, self.merges.compatible
        out: list[str] = []
        given_up: set[int] = set()
        at, last = 0, ""
        token = inside[s[: reach(s[:width])]]
        while True:
            while token is not None:
                if not given_up or at + len(token) not in given_up:
                    fits = known.get((last, token)) if last else True
                    if fits or (fits is None and compatible(last, token)):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at += len(token)
                if at == size:
                    return out
                last = token
                token = inside[s[at : at + reach(s[at : at + width])]]
            elif out:
                given_up.add(at)
                last = out.pop()
                at -= len(last)
                token, last = shorter[last], out[-1] if out else ""
            else:
                raise ValueError("the vocabulary can't express this piece")

    def encode(self, text: str) -> str:
        """The ids of a text, as decimal numbers with one space between."""
        return " ".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


def read_ranks(path: str) -> dict[bytes, int]:
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in filter(None, lines)}


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    CACHES[__name__] = codec.cache_clear
    return Codec(read_ranks(path), pattern)


def _over_texts(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, fields: dict[str, str], each: Callable[[Codec, str], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in blocks(batches, "text"):
            found = [each(own, t) for t in strings(part.column("text"))]
            kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
            arrays = [pa.array(x, kinds[k]) for x, k in zip(zip(*found, strict=True), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], ["id", *fields])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, ", ".join([f"id {kind}", *(f"{k} {v}" for k, v in fields.items())])).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) of every text."""
    return _over_texts(docs, path, pattern, id_col, text_col, {"ids": "array<int>"}, lambda own, t: ([int(i) for i in own.encode(t).split(" ")] if t else [],))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, bytes of every list of ids; null: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in read_ranks(path).items()}
        for batch in batches:
            found = [b"".join(map(token.__getitem__, ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def _digests(own: Codec, text: str) -> tuple[int, str, str]:
    ids = own.encode(text)
    return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and digests of the ids and of the bytes that they decode to; no shuffle."""
    return _over_texts(docs, path, pattern, id_col, text_col, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, _digests)
