"""Encoding a corpus with a public byte-level BPE vocabulary.

Merges follow a priority queue of merge ranks over a doubly linked list of
symbols; entries of the queue that a merge has made stale are skipped. Texts
are split by the vocabulary's own pattern, and a bounded cache keeps the ids of
pieces seen before. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.functions.names import fresh, ref

#: Pieces a worker remembers; only memory and speed depend on it.
CACHE = 1 << 17


def default_vocabulary() -> str:
    """Path of the vocabulary ``byte_bpe_50k`` as ranks, in the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    """The splitting pattern that belongs to that vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class BytePairEncoder:
    """Byte-level BPE by merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE) -> None:
        import regex

        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cached = lru_cache(maxsize=cache)(self.encode_piece)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, merging the lowest-ranked neighbours first (leftmost among equals)."""
        data, ranks = piece.encode("utf-8"), self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return (whole,)
        symbols: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                queue.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = right[i]
            # Stale: one of the two symbols has been merged since.
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                rank = ranks.get(symbols[i] + symbols[right[i]])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, symbols[i], symbols[right[i]]))
            if left[i] >= 0:
                rank = ranks.get(symbols[left[i]] + symbols[i])
                if rank is not None:
                    heapq.heappush(queue, (rank, left[i], symbols[left[i]], symbols[i]))
        return tuple(ranks[s] for s in symbols if s is not None)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        out: list[int] = []
        extend, cached, plain = out.extend, self.cached, self.encode_piece
        for piece in self.split(text):
            extend(cached(piece) if len(piece) < 64 else plain(piece))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that ``ids`` stand for."""
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text that ``ids`` stand for; bytes that are no UTF-8 come out as replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder for each vocabulary and worker."""
    return BytePairEncoder.from_file(path, pattern)


def _check(spark_df: DataFrame, path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or default_vocabulary(), pattern or default_pattern()


def encoded(
    df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Add ``out`` (array<int>): the token ids of ``text``.

    Null and empty texts give an empty list, blank ones the ids of their white
    space. Characters outside Unicode's scalar values cannot occur in Spark
    strings. Whole texts are encoded, however long; extra columns are kept.
    """
    path, split = _check(df, vocabulary, pattern)
    name = fresh(df, out)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path, split).encode
        for batch in batches:
            yield pa.array([encode(t) if t else [] for t in batch.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(name, F.arrow_udf(run, "array<int>")(ref(text)))


def token_counts(
    df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Add ``out`` (int): the number of tokens of ``text``; 0 for null and empty."""
    path, split = _check(df, vocabulary, pattern)
    name = fresh(df, out)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path, split).encode
        for batch in batches:
            yield pa.array([len(encode(t)) if t else 0 for t in batch.to_pylist()], pa.int32())

    return df.withColumn(name, F.arrow_udf(run, "int")(ref(text)))


def decoded(
    df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Add ``out``: the text of a list of ids; null gives the empty text."""
    path, split = _check(df, vocabulary, pattern)
    name = fresh(df, out)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = encoder(path, split).decode
        for batch in batches:
            yield pa.array([decode(x or []) for x in batch.to_pylist()], pa.string())

    return df.withColumn(name, F.arrow_udf(run, "string")(ref(ids)))
