"""Byte-level BPE by tree reduction: halves are encoded on their own and joined through re-encoded boundary windows.

Encoding is a monoid over neighbouring pieces of text. Two joins are used, both exact:

* Text: the split pattern starts a match at every blank between two letters, whatever stands further left or right. The window
  between the last such place in the left half and the first in the right half is encoded again; it grows until it
  reaches one on each side. Tokens outside lie in matches that the other half cannot touch.
* Within one match: a sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of
  theirs. The window takes one token from each side and doubles until both of its outer pairs pass that test.

Decoding concatenates the bytes of halves up the same kind of tree. Leaves go to the public library for the rank file.

Defined results: null and empty texts have no tokens and decode to no bytes. Rows are encoded in place, so repeated rows, null
ids and extra columns need no care.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF_CHARS = 2048
LEAF_TOKENS = 8192
_SURE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


class Codec:
    """Encoding and decoding by the ranks of one file; leaf sizes are parameters so that tests can force deep trees."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.library._core_bpe.encode_single_piece
        self.split = regex.compile(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.leaf = leaf
        self.fits = lru_cache(1 << 16)(self._fits)

    def _fits(self, left: int, right: int) -> bool:
        return self.piece(self.token[left] + self.token[right]) == [left, right]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.library.encode_ordinary(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        start, end = _last_sure(left), _first_sure(right)
        cut = _tokens_of(self.token, reversed(left_ids), len(left[start:].encode()))
        skip = _tokens_of(self.token, right_ids, len(right[:end].encode()))
        return left_ids[: len(left_ids) - cut] + self.window(left[start:] + right[:end]) + right_ids[skip:]

    def window(self, text: str) -> list[int]:
        """A window's tokens; its long matches are trees themselves."""
        if len(text) <= 2 * self.leaf:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for match in self.split.finditer(text):
            ids += self.match(match.group().encode())
        return ids

    def match(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if len(data) <= self.leaf:
            return self.piece(data)
        half = len(data) // 2
        left, right = self.match(data[:half]), self.match(data[half:])
        size = 1
        while True:
            a, b = left[:-size], right[size:]
            inner = self.piece(b"".join(map(self.token.__getitem__, left[-size:] + right[:size])))
            if (not a or self.fits(a[-1], inner[0])) and (not b or self.fits(inner[-1], b[0])):
                return a + inner + b
            size *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return self.library.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _last_sure(text: str) -> int:
    """The last place where a match starts for sure; 0 if the window must take the whole text."""
    size = 64
    while True:
        begin = max(0, len(text) - size)
        found = None
        for found in _SURE.finditer(text, begin):
            pass
        if found or not begin:
            return found.start() if found else 0
        size *= 4


def _first_sure(text: str) -> int:
    found = _SURE.search(text)
    return found.start() if found else len(text)


def _tokens_of(token: dict[int, bytes], ids, size: int) -> int:
    """How many tokens hold the next `size` bytes."""
    count = 0
    for i in ids:
        if size <= 0:
            break
        size -= len(token[i])
        count += 1
    assert size == 0, "a sure place is a token's edge"
    return count


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """The token ids of a text as array<int>; no ids for null."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for values in batches:
            # One text's ids at a time are Python numbers; a batch holds them as 32-bit integers.
            ids = [np.array(own.encode(v.as_py() or ""), np.int32) for v in values]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    return F.coalesce(encode(text), F.array().cast("array<int>"))


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of token ids as binary; no bytes for null."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for values in batches:
            flat, ends = values.values.to_numpy(), values.offsets.to_numpy()
            yield pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return F.coalesce(decode(ids), F.lit("").cast("binary"))
