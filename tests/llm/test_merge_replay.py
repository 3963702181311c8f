import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intakespark.llm import merge_replay, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = merge_replay.read_ranks(open(PATH, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=25), st.randoms(), st.lists(st.text("abc", min_size=1, max_size=40), min_size=1, max_size=8))
def test_any_ranks(tokens, rng, words):
    """Ranks in any order: merges whose product has a lower rank than the pair before it, and tokens reached in several ways."""
    order = [bytes([b]) for b in range(256)] + [t.encode() for t in tokens]
    rng.shuffle(order)
    ranks = {t: k for k, t in enumerate(order)}
    plain = tiktoken.Encoding("any", pat_str=r"[a-c]+", mergeable_ranks=ranks, special_tokens={})
    table = merge_replay.MergeTable(ranks)
    values, ends = merge_replay.replay([w.encode() for w in words], table)
    for word, ids in zip(words, (x.tolist() for x in np.split(values, ends[:-1]))):
        whole = ranks.get(word.encode())
        assert ([whole] if whole is not None else ids) == plain.encode_ordinary(word)


SAMPLES = [
    "",
    None,
    " ",
    "Hello, World!! it's 'sabc don't x's 12345 a1b2 3.14, 'LL I'll  two   spaces \n\n\t end \n",
    "<|endoftext|> <|im_start|> \x1cfs\x1f \x85nel 　 \xa0nbsp ​",
    "été ́ Größe straße naïve 你好。世界 \U0001f600\U0001f468‍\U0001f469 İ ΣΣ नमस्ते مرحبا",
    "x" * 20_000 + "!" * 300 + "9" * 200,
    "ab" * 9_000,
    " ".join(["long text repeated,"] * 3000),
]


def test_equals_library(spark, library, monkeypatch):
    rng = random.Random(5)
    marks = [chr(c) for c in range(1, 127)] + list("éß́KΣ你  ñ") + ["'s", "'re", "the", "ing", "  "]
    texts = SAMPLES + ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int")
    rows = merge_replay.encode_decode_bytes(df, PATH, public_tokenizers.PATTERN).select("doc_id", "ids", "decoded", merge_replay.ids_text(F.col("ids")).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.ids == ids and bytes(r.decoded) == text.encode() == library.decode_bytes(ids), text[:80]
        assert r.s == ",".join(map(str, ids))


def test_stretches_and_cache_bounds_keep_results(library, monkeypatch):
    monkeypatch.setattr(merge_replay, "STRETCH", 50)
    monkeypatch.setattr(merge_replay, "CACHE_WORDS", 5)
    monkeypatch.setattr(merge_replay, "RUN_BYTES", 16)
    enc = merge_replay.WordEncoder(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    texts = [t for t in SAMPLES if t is None or len(t) < 5000] + ["wort " * 400 + "   ende\n\n"]
    got = enc.encode(texts)
    for text, ids, raw in zip(texts, got.column(0).to_pylist(), got.column(1).to_pylist()):
        assert ids == library.encode_ordinary(text or "") and raw == (text or "").encode()


def test_empty_table_and_foreign_vocabulary(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert merge_replay.encode_decode_bytes(df, PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="single bytes"):
        merge_replay.MergeTable({b"a": 0, b"ab": 1})


def test_query_whole_table(spark, library):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op13_merge_replay(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()
