import hashlib
import random

import pytest
from pyspark.sql import functions as F

from intakespark.llm import bpe, queries

SAMPLES = [
    "",
    None,
    "Hello, World!! it's 'sabc don't x's !'s ''re 12345 a1b2 3.14, 'LL I'LL",
    "<|startoftext|>hi<|endoftext|> <|ENDOFTEXT|> <<|endoftext|>> a<|b|>c <|end of text|>",
    "tab\tnew\nline\x0bvt\x0cff\rcr  two  \x1cfs\x1fus nbsp x em\u0085nel",
    "été, ́lone ;̸ ≠ ≮| 1⃣ KK İstanbul ΣΣ straße naïve 你好。\U0001f600ok\U0001f468‍\U0001f469",
    "x" * 5000 + "!" * 300 + "9" * 200,
    " ".join(["long text repeated,"] * 3000),
    "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\" +1 (017) 555-7713 und.34@mail7.example.com 97.51.17.173",
]


def whole(text):
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(queries.tokenizer_path())
        _T.no_truncation()
        _T.no_padding()
    ids = _T.encode(text or "", add_special_tokens=False).ids
    return ids, _T.decode(ids, skip_special_tokens=False)


def test_equals_whole_text_encoding(spark):
    rng = random.Random(5)
    marks = [chr(c) for c in range(1, 127)] + list("éß́KΣ你 ") + ["'s", "'re", "<|endoftext|>", "the", "ing"]
    texts = SAMPLES + ["".join(rng.choices(marks, k=rng.randint(1, 60))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.encode_decode(df, queries.tokenizer_path()).select("doc_id", "ids", "decoded", bpe.ids_text(F.col("ids")).alias("s")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, said = whole(texts[r.doc_id])
        assert (r.ids, r.decoded) == (ids, said), texts[r.doc_id]
        assert r.s == " ".join(map(str, ids))


def test_cuts_are_outside_every_token():
    import json

    spec = json.load(open(queries.tokenizer_path(), encoding="utf-8"))
    cuts = bpe.certain_cuts(spec)
    assert ("n", ",") in cuts or ("1", "2") in cuts
    texts = [t.removesuffix("</w>") for t in spec["model"]["vocab"]]
    for a, b in cuts:
        assert not (a == "'" and b in "strvmld")
    joined = "\n".join(texts)
    for a, b in list(cuts)[:400]:
        assert (a + b).lower() not in joined


def test_cache_bound_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PARTS", 3)
    enc = bpe.PartEncoder(open(queries.tokenizer_path(), encoding="utf-8").read())
    for t in ("one two three", "four five six seven", "one seven"):
        got = enc.encode([t.encode()])
        assert got.column("ids")[0].as_py() == whole(t)[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(df, queries.tokenizer_path()).count() == 0


def test_query_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op10_bpe_forced_boundaries(spark, d).collect():
        ids, said = whole(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
