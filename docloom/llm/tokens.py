"""Encoding with a public byte-level BPE tokenizer by prefix dynamic programming.

A sequence of tokens is what BPE makes of a text exactly if every two neighbours
are what BPE makes of their own concatenation. So each prefix of a piece has one
valid last token, and it is found from shorter prefixes: the token that ends here
and fits the last token of the prefix before it. The table of last tokens takes
time in proportion to the bytes, whatever their number, grows by appending without
touching what is there, and after an edit is recomputed only until it agrees again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

#: The vocabulary as lines of base64 token and rank; a parameter everywhere.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte_bpe_50k splits a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ID = -1


class Vocabulary:
    def __init__(self, path: str = BYTE_BPE_50K, pieces: str = PIECES) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(pieces).findall
        self.backward: dict = {}  # tokens read from their last byte to their first
        for token, i in self.ids.items():
            node = self.backward
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[_ID] = i
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: merge the pair of the lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before`` (-1: begin a piece)."""
        pair = (before + 1 << 20) | token
        known = self._fits.get(pair)
        if known is None:
            left, right = self.bytes[before] if before >= 0 else b"", self.bytes[token]
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self._fits) > 2_000_000:  # a memo only: forgetting costs time, not results
                self._fits.clear()
            self._fits[pair] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        known = self._pieces.get(piece)
        if known is None:
            known = PrefixTable(self, piece.encode()).tokens()
            if len(piece) <= 24:
                if len(self._pieces) > 200_000:
                    self._pieces.clear()
                self._pieces[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            out += self.encode_piece(piece)
        return out


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _token(self, end: int) -> int:
        data, last, fits, node, at = self.data, self.last, self.vocabulary.fits, self.vocabulary.backward, end
        while at > 0:
            at -= 1
            node = node.get(data[at])
            if node is None:
                break
            token = node.get(_ID)
            if token is not None and fits(last[at], token):
                return token
        raise ValueError("a byte is missing from the vocabulary")

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._token(end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Put ``data`` for the bytes [start, stop); returns how many entries were computed anew."""
        old, shift = self.last, len(data) - (stop - start)
        self.data = self.data[:start] + data + self.data[stop:]
        self.last = old[: start + 1]
        agree, end = 0, start
        while end < len(self.data):
            end += 1
            self.last.append(self._token(end))
            before = end - shift
            agree = agree + 1 if before > stop and self.last[end] == old[before] else 0
            if agree >= self.vocabulary.longest:  # no later token reaches further back
                self.last += old[before + 1 :]
                break
        return end - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[self.last[end]])
        return out[::-1]


class EncodedText:
    """A text with its token ids that can be appended to without encoding it again."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary = vocabulary
        self.pieces: list[str] = []
        self.ids: list[list[int]] = []
        self.append(text)

    def append(self, text: str) -> None:
        # what follows can only change how the last pieces are split: a run of spaces or letters, a contraction
        tail = "".join(self.pieces[-3:])
        del self.pieces[-3:], self.ids[-3:]
        for piece in self.vocabulary.split(tail + text):
            self.pieces.append(piece)
            self.ids.append(self.vocabulary.encode_piece(piece))

    def tokens(self) -> list[int]:
        return [i for ids in self.ids for i in ids]


@lru_cache(maxsize=2)
def vocabulary(path: str = BYTE_BPE_50K) -> Vocabulary:
    """Loaded once per Python worker."""
    return Vocabulary(path)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids array<int>): the token ids of every text, without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts
    have an empty list. Rows never leave their task; a text of any length is encoded
    in time proportional to its bytes. Repeated rows stay repeated.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for frame in frames:
            yield pd.DataFrame({key: frame["k"], "ids": [words.encode(t) if t else [] for t in frame["t"]]})

    return documents.select(documents[key].alias("k"), documents[text].alias("t")).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, columns: list[str], text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``columns`` and tokens: the number of tokens of every text; 0 for empty and null ones."""
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for frame in frames:
            yield frame[columns].assign(tokens=[len(words.encode(t)) if t else 0 for t in frame[text]])

    return documents.select(*dict.fromkeys([*columns, text])).mapInPandas(run, f"{kinds}, tokens bigint")
