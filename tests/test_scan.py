"""Places of many patterns: which words are looked for, and that time grows with the text."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intakespark.functions.scan import PatternSet, Reading, inside, needles
from intakespark.functions.texts import clause_reader, normalise, split_clauses, word_count
from intakespark.operators.intent import _Places
from intakespark.operators.lexicon import load_lexicon
from intakespark.sources.synthetic import NOTES


@pytest.mark.parametrize(
    "pattern, words",
    [("budget approved", {"budget approved"}), ("(?:sign|close) it", {" it", "sign", "close"}), (r"in \d+ days", {"in ", " days"}), (r"\bfree\b", {"free"}), ("a?b*", set()), ("[xy]", set()), ("(?:big )?deal", {"deal"}), ("(?:ab){2,}c", {"ab", "c"}), ("yes|no", {"yes", "no"})],
)
def test_needles(pattern, words):
    assert needles(pattern) <= words and bool(needles(pattern)) == bool(words)


def test_every_pattern_of_the_lexicon_has_a_needle():
    at = _Places(load_lexicon())
    patterns = [p["pattern"] for p in at.clauses] + [p for p, _ in at.notes]
    assert len(patterns) == 431 and sum(not needles(p) for p in patterns) <= 5


def plain(text, clause_patterns, text_patterns):
    """All places by trying every pattern on every clause."""
    reader = clause_reader()
    clauses = reader.clauses(text)
    scopes = [reader.scopes(c[2]) for c in clauses]
    places = [(k, n, m.start(), m.end(), c, any(a <= m.start() < b for a, b in scopes[c])) for c, x in enumerate(clauses) for k, p in enumerate(clause_patterns) for n, m in enumerate(re.finditer(p, x[2]))]
    firsts = []
    for k, p in enumerate(text_patterns):
        if m := re.search(p, text):
            own = [(c, x) for c, x in enumerate(clauses) if x[0] <= m.start() < x[1]][:1]
            firsts.append((k, m.start(), m.end(), any(a <= m.start() - x[0] < b for c, x in own for a, b in scopes[c])))
    return places, firsts


def read(text, clause_patterns, text_patterns):
    reading = Reading(clause_reader(), PatternSet(tuple(clause_patterns)), PatternSet(tuple(text_patterns)), [None] * len(text_patterns))
    reading.add(text)
    return [tuple(p.values()) for p in reading.place_array().to_pylist()[0]], [(f["pattern"], f["s"], f["e"], f["negated"]) for f in reading.first_array().to_pylist()[0]]


def test_same_places_as_trying_all_patterns():
    at = _Places(load_lexicon())
    clause_patterns, text_patterns = [p["pattern"] for p in at.clauses], [p for p, _ in at.notes]
    found = 0
    for note in [n.lower() for n in NOTES] + [" ".join(NOTES).lower()]:
        got = read(note, clause_patterns, text_patterns)
        assert got == plain(note, clause_patterns, text_patterns)
        found += len(got[0]) + len(got[1])
    assert found > 400


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["not", "no", "but", "so", "budget", "we", "have", ",", ".", ";", " - ", "until", "yes", "lack", "of", "still", "because"]), max_size=30))
def test_same_places_on_odd_texts(words):
    patterns = ["budget", r"\bwe have", "yes|no", "o[ft]?", "have budget", "x?"]
    text = " ".join(words)
    assert read(text, patterns, patterns) == plain(text, patterns, patterns)


def test_spans():
    assert [inside([(1, 3), (5, 6)], k) for k in range(7)] == [False, True, True, False, False, True, False]


def test_long_turns(spark):
    """A turn of 20,000 words with thousands of clauses and negations: time grows with the length, not its square."""
    piece = "we do not have a budget, but we want it because leads are slow. no rush; "
    took = []
    for n in (1_200, 4_800):
        text = piece * n
        began = time.process_time()
        got = clause_reader().clauses(text)
        spans = sum(len(clause_reader().scopes(c[2])) for c in got)
        took.append(time.process_time() - began)
        assert len(got) == 3 * n and spans == 2 * n
    assert took[1] < 12 * max(took[0], 0.02)
    row = spark.createDataFrame([(piece * 1_200,), (None,), ("",)], "t string").select(split_clauses(normalise(F.col("t"))).alias("c"), word_count(F.col("t")).alias("w")).collect()
    assert (len(row[0].c), row[0].w) == (3_600, 19_200) and row[1].c == row[2].c == []
