"""Every score of the whole table against a plain scorer that takes words and bytes one at a time."""

import math

from intakespark.llm import quality as Q
from intakespark.llm import queries
from intakespark.llm._textkit import BYTE, constants

SF = "/root/testdata/sf0.001"
MASK, ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15
GAP = {0x20, *range(0x09, 0x0E)}
BYTES, STEP = [int(x) for x in BYTE], int(constants(1, 2)[0]) | 1
AT, KIND = [int(x) for x in constants(8, 11)], [int(x) for x in constants(8, 12)]


def scramble(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def bucket(value, kind):
    return ((value ^ KIND[kind]) * AT[0] & MASK) >> (64 - Q.BITS)


def word_hash(word):
    total, power = 0, 1
    for b in word:
        total, power = total + BYTES[b] * power & MASK, power * STEP & MASK
    return scramble((total + len(word) * ODD) & MASK)


def plain_score(text, pull):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = [word_hash(w) for w in bytes(32 if b in GAP else b for b in data).split(b" ") if w]
    found = [bucket(0, 7)] + [bucket(w, 0) for w in words]
    found += [bucket((b - a) & MASK, 1) for a, b in zip(words, words[1:])] + [bucket((b - a) & MASK, 2) for a, b in zip(words, words[2:])]
    padded = b" " + data + b" " * max(Q.GRAMS)
    for n in Q.GRAMS:
        for i in range(len(data) + 1):
            gram = padded[i : i + n]
            if not any(b in GAP for b in gram[1:-1]):
                found.append(bucket(sum(BYTES[0x20 if b in GAP else b] * AT[k + 1] for k, b in enumerate(gram)) & MASK, n))
    return 1 / (1 + math.exp(-sum(pull[b] for b in found) / len(found)))


def test_every_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pull = Q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).pull.tolist()
    want = {r.doc_id: plain_score(r.text, pull) for r in docs.collect()}
    got = {r.doc_id: r.score for r in queries.op4_quality(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
