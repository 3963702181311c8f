import random
import re
from collections import Counter, defaultdict

import pytest

from intakespark.llm import ngram_jaccard as J
from intakespark.llm import queries


def shingles(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, words, percent):
    """[(doc_id, size, component)] by comparing every pair of sets that share a shingle; rows of one id are one node."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                lists[x].append(k)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for o, n in Counter(j for x in s for j in lists[x] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[o][1]) - n):
                a, b = find(i), find(sets[o][0])
                up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def got(spark, rows, words=4, percent=85):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, words, percent).documents.collect()), key=repr)


def noisy(rng, words, edits, lexicon):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(lexicon)
    return " ".join(out)


def test_groups_of_every_size(spark):
    rng = random.Random(3)
    lexicon = [f"w{k}" for k in range(4000)]
    rows = [(None, "a b c d e"), (900, None), (901, ""), (902, " \t\n"), (903, "Solo"), (904, "solo"), (905, "two words"), (905, "other words here now"), (906, "other words here now"), (907, "two  WORDS")]
    i = 1000
    for n in [4, 6, 9, 10, 11, 15, 16, 17, 18, 22, 30, 60, 200]:
        base = [rng.choice(lexicon) for _ in range(n)]
        for e in (0, 0, 0, 1, 1, 1, 2, 3):
            rows.append((i, noisy(rng, base, e, lexicon)))
            rows.append((i + 1, " ".join(base) + " tail" * (e + 1)))
            i += 2
    passage = " ".join(rng.choice(lexicon) for _ in range(60))
    for _ in range(60):
        rows.append((i, passage + " " + " ".join(rng.choice(lexicon) for _ in range(rng.choice([4, 12, 40])))))
        i += 1
    rows.append((i, "word " * 30_000))
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows, 4, 85)
    assert got(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_chain_of_near_copies(spark):
    base = [f"c{k}" for k in range(80)]
    rows = [(k, " ".join(base[k : k + 70])) for k in range(0, 10)]
    assert got(spark, rows, 2, 90) == brute(rows, 2, 90)


def test_boundary_is_cheapest():
    assert J.choose_boundary({}, 85) == 0
    assert J.choose_boundary({5: (10, 10_000)}, 85) > 0
    assert J.choose_boundary({24: (1000, 10)}, 85) == 0


def test_forced_light_path(spark, monkeypatch):
    rng = random.Random(8)
    lexicon = [f"v{k}" for k in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(lexicon) for _ in range(rng.choice([8, 12, 14, 16, 20]))]
        rows += [(g * 10 + k, noisy(rng, base, rng.choice([0, 0, 1]), lexicon)) for k in range(6)]
    for light in (0, 7, 13, 16):
        monkeypatch.setattr(J, "choose_boundary", lambda sizes, percent, light=light: light)
        assert got(spark, rows, 1, 80) == brute(rows, 1, 80)


def test_empty(spark):
    assert got(spark, []) == []


def test_query_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op1_ngram_jaccard(spark, d).select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute(rows, 4, 85)
