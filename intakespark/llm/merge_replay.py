"""Byte-level BPE by replaying merges over all distinct words at once.

Texts are cut into words by the vocabulary's pattern. The words that a run of
texts brings in are laid end to end as bytes, and an inverted index says at
which places each mergeable pair of tokens stands. Merges are then applied in
rank order: the index gives the places of the lowest rank, each of them is
merged, and only the pairs with its left and right neighbour are looked up
again. Within a word the order is that of encoding it alone (lowest rank first,
of equal ranks the leftmost), so the ids are the same.

Words repeat endlessly in a corpus, so each process keeps the ids of words that
it has replayed in a bounded table. The vocabulary file is read on the driver
and broadcast (about a MB, whatever the corpus), so executors need no copy.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices

#: Words a process learns before it forgets those that it has not met since as many before; bytes of words replayed together; words of a text looked at together.
CACHE_WORDS, RUN_BYTES, STRETCH = 250_000, 1 << 21, 1 << 18


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token to rank of a vocabulary file: a line for each token, in base64, and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


class MergeTable:
    """Ranks of tokens and of the pairs that have been asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.wide = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}

    def pair(self, left: int, right: int) -> int:
        """Rank of the token that two tokens make together, or -1."""
        key = left * self.wide + right
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return rank


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, one after another; where each word's ids end), from one replay of all merges over all words."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    begins = [0, *ends[:-1].tolist()]
    start = table.of_byte[raw]
    n = len(start)
    first = np.full(n, -1, np.int64)
    if n > 1:
        keys, back = np.unique(start[:-1] * table.wide + start[1:], return_inverse=True)
        first[:-1] = np.array([table.pair(*divmod(key, table.wide)) for key in keys.tolist()], np.int64)[back]
        first[ends[ends > 0] - 1] = -1
    held = np.flatnonzero(first >= 0)
    held = held[np.argsort(first[held], kind="stable")]
    found, at = np.unique(first[held], return_index=True)
    index = dict(zip(found.tolist(), (x.tolist() for x in np.split(held, at[1:])))) if len(held) else {}
    heap = list(index)
    heapify(heap)

    token, rank_at = start.tolist(), first.tolist()
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    for b, e in zip(begins, ends.tolist()):
        if e > b:
            left[b], right[e - 1] = -1, -1
    pair, known, wide = table.pair, table.pairs.get, table.wide

    while heap:
        rank = heappop(heap)
        places = index.pop(rank)
        places.sort()
        stop, later = -1, []
        for p in places:
            if p < stop:
                later.append(p)
                continue
            if rank_at[p] != rank:
                continue
            gone = right[p]
            token[p], token[gone], rank_at[gone] = rank, -1, -1
            after, before = right[gone], left[p]
            right[p] = after
            made = -1
            if after >= 0:
                left[after] = p
                made = known(rank * wide + token[after])
                if made is None:
                    made = pair(rank, token[after])
                if made >= 0:
                    if made in index:
                        index[made].append(p)
                    else:
                        index[made] = [p]
                        heappush(heap, made)
            rank_at[p] = made
            lower = 0 <= made < rank
            if before >= 0:
                made = known(token[before] * wide + rank)
                if made is None:
                    made = pair(token[before], rank)
                rank_at[before] = made
                if made >= 0:
                    lower |= made < rank
                    if made in index:
                        index[made].append(before)
                    else:
                        index[made] = [before]
                        heappush(heap, made)
            if lower:
                # A lower rank has come up in this word: it goes before the word's other places of this rank.
                stop = int(ends[bisect_right(begins, p) - 1])
        if later:
            index[rank] = later
            heappush(heap, rank)
    last = np.array(token, np.int32)
    alive = last >= 0
    return last[alive], np.concatenate(([0], np.cumsum(alive)))[ends]


class WordEncoder:
    """Encodes texts word by word and remembers the ids of words."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        self.table = MergeTable(read_ranks(raw))
        self.split = regex.compile(pattern)
        size = self.table.wide
        self.bytes = pa.array([self.table.token.get(i, b"") for i in range(size)], pa.binary())
        self.ids: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in order, a stretch at a time where it is very long."""
        if len(text) <= STRETCH:
            yield self.split.findall(text)
            return
        matches = self.split.finditer(text)
        while part := [m.group() for m in islice(matches, STRETCH)]:
            yield part

    def learn(self, words: set[str]) -> None:
        """Replay and remember the words that are not known yet. A word that is a token itself is that token."""
        if len(self.ids) + len(words) > CACHE_WORDS:
            self.ids, self.before = {}, self.ids
        new, size = [], 0
        for word in words:
            if word in self.ids:
                continue
            if word in self.before:
                self.ids[word] = self.before[word]
                continue
            raw = word.encode()
            whole = self.table.ranks.get(raw)
            if whole is not None:
                self.ids[word] = np.int32(whole).tobytes()
                continue
            new.append((word, raw))
            size += len(raw)
            if size >= RUN_BYTES:
                self._replay(new)
                new, size = [], 0
        if new:
            self._replay(new)

    def _replay(self, new: list[tuple[str, bytes]]) -> None:
        values, ends = replay([raw for _, raw in new], self.table)
        ids, low = values.tobytes(), 0
        for (word, _), high in zip(new, (4 * ends).tolist()):
            self.ids[word], low = ids[low:high], high

    def encode(self, texts: list[str | None]) -> pa.RecordBatch:
        """Columns ids and decoded of texts: together about as long as the texts themselves."""
        if sum(len(t or "") for t in texts) <= 4 * STRETCH:
            split = [[w for part in self.words(t or "") for w in part] for t in texts]
            self.learn({w for words in split for w in words})
            ids = [b"".join(map(self.ids.__getitem__, words)) for words in split]
        else:
            ids = [self._encode_long(t or "") for t in texts]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        decoded = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.bytes.take(values)), pa.scalar(b"", pa.binary()))
        return pa.RecordBatch.from_arrays([lists, decoded], ["ids", "decoded"])

    def _encode_long(self, text: str) -> bytes:
        out = bytearray()
        for words in self.words(text):
            self.learn(set(words))
            out += b"".join(map(self.ids.__getitem__, words))
        return bytes(out)


_encoders: dict[int, WordEncoder] = {}


def _encoder(raw: bytes, pattern: str) -> WordEncoder:
    """This process's encoder of a vocabulary: what it remembers serves all tasks the process runs."""
    key = hash((raw, pattern))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(raw, pattern)
    return _encoders[key]


def encode_decode_bytes(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Replace columns ``ids`` (array of int) and ``decoded`` (binary) with the encoding of every whole text and the bytes its ids stand for.

    Equal to encoding the whole text with the tiktoken library by the same ranks and pattern, without special tokens.
    Null and empty texts give no ids and no bytes. All other columns and every row, repeated ones too, are kept; an
    empty table gives an empty one. Very long texts are taken a stretch of words at a time.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, at):
                new = encoder.encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *new.columns], [*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.translate(ids.cast("string"), "[] ", "")
