"""Quality classifier with supervised subword embeddings.

Words, word pairs and character n-grams (three and five bytes within a word,
its borders marked) are hashed to buckets. A pair is hashed by the difference
of its words' hashes, so all immediate repetitions share one bucket, and
likewise all repetitions two words apart. Each bucket has a learned vector; a document is
the mean of its features' vectors; a softmax over two outputs gives the score.
Training is stochastic gradient descent in numpy on a bounded sample of
labelled documents (``SAMPLE`` of them, chosen by a hash of the id). Since the
output is linear in the mean, scoring needs one learned number a bucket, which
is broadcast (2**BITS numbers).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._textkit import BYTE, LOWER, SPACE, constants, word_hashes
from .bpe import slices

#: Most labelled documents that training looks at.
SAMPLE = 2_000
BITS, DIM, EPOCHS, RATE, SEED = 16, 8, 12, 0.8, 7
THRESHOLD = 0.3
GRAMS = (3, 5)
_AT, _KIND = constants(8, 11), constants(8, 12)
_STRETCH = 1 << 19


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes ^ _KIND[kind]) * _AT[0] >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of all features of a lower-cased text, in stretches; every text has one feature that marks a text."""
    yield _buckets(np.zeros(1, np.uint64), 7)
    for _, hashes in word_hashes(data):
        yield _buckets(hashes, 0)
        yield _buckets(hashes[1:] - hashes[:-1], 1)
        yield _buckets(hashes[2:] - hashes[:-2], 2)
    reach = max(GRAMS)
    padded = b" " + data + b" " * reach
    for low in range(0, len(data) + 1, _STRETCH):
        raw = np.frombuffer(padded[low : low + _STRETCH + reach], np.uint8)
        gap, codes = SPACE[raw], BYTE[raw]
        codes = np.where(gap, BYTE[0x20], codes)
        size = min(_STRETCH, len(data) + 1 - low)
        for n in GRAMS:
            sums, inner = codes[:size] * _AT[1], np.ones(size, bool)
            for k in range(1, n):
                sums = sums + codes[k : size + k] * _AT[k + 1]
                if k < n - 1:
                    inner &= ~gap[k : size + k]
            yield _buckets(sums[inner], n)


@dataclass
class Model:
    """Vectors of the buckets and weights of the outputs; ``pull`` is each bucket's part in the score's logit."""

    vectors: np.ndarray
    outputs: np.ndarray

    @property
    def pull(self) -> np.ndarray:
        return (self.vectors @ (self.outputs[1] - self.outputs[0])).astype(np.float64)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit by stochastic gradient descent; samples are (buckets, counts). Without samples every score is 0.5."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    outputs = np.zeros((2, DIM), np.float32)
    if samples:
        outputs[1] = 0.01
    parts = [(n / n.sum()).astype(np.float32) for _, n in samples]
    steps, done = max(1, epochs * len(samples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            ids, part, own = samples[k][0], parts[k], labels[k]
            hidden = part @ vectors[ids]
            z = outputs @ hidden
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[own] -= 1
            pace = np.float32(rate * (1 - done / steps))
            back = error @ outputs
            outputs -= pace * np.outer(error, hidden).astype(np.float32)
            # The mean spreads the step over all features; scaled by their number it moves each as fast as a lone one.
            vectors[ids] -= (pace * len(ids) ** 0.5) * part[:, None] * back[None, :].astype(np.float32)
            done += 1
    return Model(vectors, outputs)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: CRC-32 of the id as text divides by 5. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents outside the held-out fifth.

    Labels with a null id or target are left out; of an id labelled both ways the larger label counts, and of
    rows that share an id several texts are used, ``2 * sample`` in all at most.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                ids, counts = [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    seen = np.zeros(1 << BITS, np.int64)
                    for b in features((text or b"").translate(LOWER)):
                        seen += np.bincount(b, minlength=1 << BITS)
                    own = np.flatnonzero(seen)
                    ids.append(own.astype(np.int32).tobytes())
                    counts.append(seen[own].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "label", "ids", "counts"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    got = texts.mapInArrow(count, "doc_id long, label int, ids binary, counts binary").limit(2 * sample).collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.ids), bytes(r.counts)))
    return train([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.float32)) for r in got], [int(r.label > 0) for r in got])


def score_texts(texts: list[bytes | None], pull: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for k, text in enumerate(texts):
        total, n = 0.0, 0
        for b in features((text or b"").translate(LOWER)):
            total += float(pull[b].sum())
            n += len(b)
        out[k] = total / n
    return 1 / (1 + np.exp(-out))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Add the score (0 to 1, higher: likelier of label 1) of every whole text.

    Null and empty texts get the score of a text without words. Every row is kept, repeated ones get equal scores; a
    column of that name is replaced; an empty table gives an empty one.
    """
    docs = docs.drop(name)
    pull = docs.sparkSession.sparkContext.broadcast(model.pull)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).cast(pa.binary() if part.column(at).type == pa.string() else pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_texts(texts, pull.value), pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(run, schema)
