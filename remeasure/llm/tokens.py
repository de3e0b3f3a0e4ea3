"""Problem 7: token ids of the whole corpus in a public byte-level BPE vocabulary.

Method: forced-boundary splitting. Merges never cross a byte pair that occurs inside no
vocabulary token, nor the pattern's own cuts. Text is cut there, each fragment is encoded by
itself, and the ids are concatenated. Fragments recur, so each task encodes a fragment once.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space after anything else begins a pretoken, whatever comes before. \x1c to \x1f are
#: white space for the re module but not for the pattern.
_UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Entries of a task's memory of fragments; beyond that it starts anew. Results don't depend on it.
_MEMORY, _LONGEST_KEPT = 400_000, 64
_ROWS_AT_ONCE = 256


def read_ranks(path: str = RANKS) -> bytes:
    """The vocabulary file as it is (under 1 MB), to be sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes texts with the vocabulary in ``ranks``, the content of a rank file."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.inside = np.zeros(65536, bool)
        for token in self.rank:
            b = np.frombuffer(token, np.uint8).astype(np.int64)
            self.inside[b[:-1] * 256 + b[1:]] = True
        self.pretokens = regex.compile(PATTERN)
        self.units: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _merged(self, piece: bytes) -> list[int]:
        """The ids of one fragment: the lowest-ranked pair is merged first, the leftmost of equals."""
        if piece in self.rank:
            return [self.rank[piece]]
        n = len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.rank.get(piece[i : end[j]])) is not None:
                heapq.heappush(waiting, (r, i, end[i], end[j]))

        waiting: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, middle, stop = heapq.heappop(waiting)
            if not alive[i] or end[i] != middle or (j := after[i]) >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.rank[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _pretoken(self, text: str) -> bytes:
        found = self.known.get(text)
        if found is not None:
            return found
        piece = text.encode()
        b = np.frombuffer(piece, np.uint8).astype(np.int64)
        cuts = np.flatnonzero(~self.inside[b[:-1] * 256 + b[1:]]) + 1
        ids: list[int] = []
        start = 0
        for cut in [*cuts.tolist(), len(piece)]:
            ids += self._merged(piece[start:cut])
            start = cut
        found = np.array(ids, np.int32).tobytes()
        if len(text) <= _LONGEST_KEPT:
            if len(self.known) >= _MEMORY:
                self.known.clear()
            self.known[text] = found
        return found

    def _unit(self, text: str) -> bytes:
        found = b"".join(map(self._pretoken, self.pretokens.findall(text)))
        if len(text) <= _LONGEST_KEPT:
            if len(self.units) >= _MEMORY:
                self.units.clear()
            self.units[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as packed 32-bit integers."""
        known, unit = self.units.get, self._unit
        return b"".join([known(u) or unit(u) for u in _UNIT.findall(text)])


_encoders: dict[int, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _encoded_batches(ranks, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(at, _ROWS_AT_ONCE)
                coded = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                if count_only:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes)], names=["doc_id", "text_hash", "n_tokens"])
                    continue
                flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``, without special tokens.

    Null and empty texts have the empty list. Strings that look like special tokens are ordinary
    text. Repeated rows are encoded as often as they occur, other columns are left out. Texts are
    encoded whole where they lie: there is no shuffle.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(_encoded_batches(ranks, False), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, text_hash, n_tokens) of every row of ``documents``; 0 tokens for null and empty texts."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return texts.mapInArrow(_encoded_batches(ranks, True), "doc_id bigint, text_hash bigint, n_tokens bigint")
