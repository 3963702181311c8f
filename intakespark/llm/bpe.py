"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never
be merged across. Where the pre-tokenizer also ends a piece between the two,
the text may be cut there for certain: the parts are encoded on their own and
the ids concatenated. Around ASCII white space this holds for every pair; other
certain pairs (a letter and a comma, two digits) are read off the vocabulary.
Parts repeat endlessly in a corpus, so each process keeps those it has encoded
in a bounded table and mostly concatenates ready-made ids.

The tokenizer file's text is read on the driver and broadcast (a few MB, as
large as its vocabulary), so executors need no copy.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts a process remembers before it starts afresh, and parts encoded in one call.
CACHE_PARTS = 250_000
RUN = 2_000
_CONTRACTED = frozenset("strvmld")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, by the public rule of that scheme."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pairs_inside_tokens(spec: dict) -> set[tuple[int, int]]:
    """Neighbouring bytes that occur inside some token of the vocabulary."""
    back, suffix = byte_alphabet(), spec["model"].get("end_of_word_suffix") or ""
    inside: set[tuple[int, int]] = set()
    for token in spec["model"]["vocab"]:
        own = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
        codes = [back[c] for c in own] if all(c in back for c in own) else list(own.encode())
        inside.update(zip(codes, codes[1:]))
    for token in spec.get("added_tokens", ()):
        codes = token["content"].encode()
        inside.update(zip(codes, codes[1:]))
    return inside


def certain_cuts(spec: dict) -> set[tuple[str, str]]:
    """Pairs of ASCII characters, neither white space, between which a text may be cut.

    The pair occurs in no token, and the two are of different classes (letter, digit, other) or both digits,
    so the pre-tokenizer's pieces end there in any context; an apostrophe stays with a letter that may be a contraction.
    """
    inside = pairs_inside_tokens(spec)
    kind = lambda c: "letter" if c in string.ascii_letters else "digit" if c in string.digits else "other"
    marks = [c for c in map(chr, range(0x21, 0x7F))]
    return {
        (a, b)
        for a in marks
        for b in marks
        if (ord(a.lower()), ord(b.lower())) not in inside
        and (kind(a) != kind(b) or kind(a) == "digit")
        and not (a == "'" and b.lower() in _CONTRACTED)
    }


def _cut_pattern(cuts: set[tuple[str, str]]) -> re.Pattern | None:
    after: dict[str, list[str]] = {}
    for a, b in sorted(cuts):
        after.setdefault(a, []).append(b)
    same: dict[str, list[str]] = {}
    for a, bs in after.items():
        same.setdefault("".join(bs), []).append(a)
    parts = [f"(?<=[{re.escape(''.join(left))}])(?=[{re.escape(right)}])" for right, left in same.items()]
    return re.compile("|".join(parts)) if parts else None


def _one_piece(part: str) -> bool:
    """Whether the pre-tokenizer surely keeps a part as one piece, which then ends in exactly one end-of-word token."""
    if part.isascii():
        return part.isalpha() or len(part) == 1
    return part.isalpha() and max(part) < "\u0250" and "\u0130" not in part


class PartEncoder:
    """Encodes texts part by part and remembers the ids of parts."""

    def __init__(self, spec_text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(spec_text)
        if spec.get("decoder") is not None:
            raise ValueError("a vocabulary whose decoder is not the plain one needs whole-text decoding")
        self.tokenizer = Tokenizer.from_str(spec_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = _cut_pattern(certain_cuts(spec))
        self.suffix = spec["model"].get("end_of_word_suffix")
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.tokens = pa.array(tokens, pa.string())
        self.ends = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in tokens])
        self.ids: dict[bytes, bytes] = {}

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts as int32 bytes. Parts of one piece are encoded many at a time and told apart by their end-of-word tokens."""
        plain = [p for p in parts if _one_piece(p)] if self.suffix else []
        out: dict[str, bytes] = {}
        for at in range(0, len(plain), RUN):
            run = plain[at : at + RUN]
            ids = np.array(self.tokenizer.encode(" ".join(run), add_special_tokens=False).ids, np.int32)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(run):
                raw, start = ids.tobytes(), 0
                for p, end in zip(run, cuts.tolist()):
                    out[p], start = raw[start:end], end
        rest = [p for p in parts if p not in out]
        for at in range(0, len(rest), RUN):
            run = rest[at : at + RUN]
            for p, code in zip(run, self.tokenizer.encode_batch_fast(run, add_special_tokens=False)):
                out[p] = array("i", code.ids).tobytes()
        return out

    def learn(self, parts: set[bytes]) -> None:
        """Encode and remember the white-space-free parts that are not known yet."""
        if len(self.ids) + len(parts) > CACHE_PARTS:
            self.ids = {}
        new = [p for p in parts if p not in self.ids]
        if not new:
            return
        split = [p.decode() for p in new]
        pieces = [[p] if p.isalpha() or not self.cut else self.cut.split(p) for p in split]
        known = self._encode_parts(list({x for each in pieces for x in each}))
        for p, each in zip(new, pieces):
            self.ids[p] = known[each[0]] if len(each) == 1 else b"".join(map(known.__getitem__, each))

    def encode(self, texts: list[bytes | None]) -> pa.RecordBatch:
        split = [(t or b"").split() for t in texts]
        self.learn({p for parts in split for p in parts})
        ids = [b"".join(map(self.ids.__getitem__, parts)) for parts in split]
        ends = pa.array(np.cumsum([0, *map(len, ids)]) // 4, pa.int32())
        values = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(ids))])
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, values), self.decode(ends, values)], ["ids", "decoded"])

    def decode(self, ends: pa.Array, values: pa.Array) -> pa.Array:
        """The tokens of each run of ids, joined by one space: what a vocabulary without a decoder gives."""
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.tokens.take(values)), " ")


_encoders: dict[int, PartEncoder] = {}


def _encoder(spec_text: str) -> PartEncoder:
    """This process's encoder of a vocabulary: what it remembers serves all tasks the process runs."""
    key = hash(spec_text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PartEncoder(spec_text)
    return _encoders[key]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about most_bytes of text, so that memory follows bytes, not rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = run = 0
    for k, n in enumerate(sizes):
        if run and run + n > most_bytes:
            yield batch.slice(start, k - start)
            start, run = k, 0
        run += n
    if start < len(sizes):
        yield batch.slice(start)


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Replace columns ``ids`` (array of int) and ``decoded`` with the encoding of every whole text and its decoding.

    Equal to encoding the whole text with the tokenizers library, without added special tokens, and decoding
    the ids with special tokens kept. Null and empty texts give no ids and an empty decoding. All other columns
    and every row, repeated ones too, are kept; an empty table gives an empty one.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).cast(pa.binary() if part.column(at).type == pa.string() else pa.large_binary()).to_pylist()
                new = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, *new.columns], [*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def ids_text(ids):
    """Decimal ids joined by one space."""
    return F.translate(ids.cast("string"), "[],", "")
