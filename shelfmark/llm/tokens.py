"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary file is read on the driver and broadcast (under 2 MB); each
worker keeps a bounded cache of encoded words. The texts never leave their
partitions.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.runtime import spread

#: Where the public vocabularies lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept in a worker's cache, and the longest word, in bytes, that is kept.
CACHE_WORDS, CACHE_BYTES = 200_000, 64
#: Words above this many bytes are merged with a heap; repeated scans would take quadratic time.
SCAN_BYTES = 256
_NONE = 1 << 60


def read_ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in blob.splitlines() if line)}


def merge_scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short word. ``bounds`` holds the part boundaries and ``pair``
    the rank of each part joined with the next; the least rank is merged by
    deleting one boundary, then only its two neighbours are ranked again."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    bounds = list(range(len(word) + 1))
    rank = ranks.get
    pair = [rank(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == _NONE:
            break
        i = pair.index(least)
        del bounds[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = rank(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            pair[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word in n log n: parts form a linked list and a
    heap gives the least rank, the leftmost first."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Text to ids; text that looks like a special token is ordinary text."""

    def __init__(self, blob: bytes):
        import regex

        self.ranks, self.words, self.cache = read_ranks(blob), regex.compile(PATTERN).findall, {}

    def word(self, text: str) -> list[int]:
        word = text.encode("utf-8", "replace")
        ids = (merge_scan if len(word) <= SCAN_BYTES else merge_heap)(word, self.ranks)
        if len(word) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids."""
        out: list[int] = []
        if text:
            known, extend = self.cache.get, out.extend
            for piece in self.words(text):
                extend(known(piece) or self.word(piece))
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, blob: bytes) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(blob)
    return _ENCODERS[key]


def _vocabulary(path: str | None) -> tuple[str, bytes]:
    path = path or os.environ.get("SHELFMARK_VOCABULARY", VOCABULARY)
    with open(path, "rb") as f:
        return path, f.read()


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every document, in its order of rows.

    Null and empty texts have an empty list; repeated rows are encoded each;
    other columns are ignored, whatever their names. ``vocabulary`` is the path
    of a rank file.
    """
    path, blob = _vocabulary(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(blob)
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, shared.value)
        for batch in batches:
            lists = [coder.encode(x.as_py()) for x in batch.column(1)]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = spread(documents.select(F.col(key), F.col(text).cast("string")))
    return rows.mapInArrow(run, schema)


def count_tokens(documents: DataFrame, columns: list[str], text: str = "text", out: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``columns`` of every document and the number of its tokens (0 for null and empty texts)."""
    path, blob = _vocabulary(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, shared.value)
        for batch in batches:
            sizes = pa.array([len(coder.encode(x.as_py())) for x in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*columns, out])

    rows = spread(documents.select(*columns, F.col(text).cast("string").alias("_text")))
    schema = T.StructType([*(documents.schema[c] for c in columns), T.StructField(out, T.LongType())])
    return rows.mapInArrow(run, schema)
