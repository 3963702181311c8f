"""Clauses of a text and the places of many patterns in it, each in time that grows with its length.

Spark has no expression that says where all matches of a pattern are, so these few functions run on Arrow batches;
whatever follows from the places is expressions again. Several hundred patterns are looked for at once: an
Aho-Corasick automaton over words that their matches must hold goes over a text a single time, and only a pattern of
which such a word has been met is tried, and only on the clause where it stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from re import _parser as regex_parser

Span = tuple[int, int]


def needles(pattern: str) -> frozenset[str]:
    """Texts of which every match of a pattern holds at least one, in lower case; empty where none can be named."""

    def best(items) -> frozenset[str]:
        sets, run = [], ""
        for op, what in [*items, (None, None)]:
            if op is regex_parser.LITERAL:
                run += chr(what).lower()
                continue
            if run:
                sets.append(frozenset([run]))
                run = ""
            inner = None
            if op is regex_parser.BRANCH:
                each = [best(x) for x in what[1]]
                inner = frozenset().union(*each) if all(each) else None
            elif op is regex_parser.SUBPATTERN:
                inner = best(what[-1])
            elif op in (regex_parser.MAX_REPEAT, regex_parser.MIN_REPEAT, regex_parser.POSSESSIVE_REPEAT) and what[0] > 0:
                inner = best(what[2])
            elif op is regex_parser.ATOMIC_GROUP:
                inner = best(what)
            if inner:
                sets.append(inner)
        return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())

    return best(regex_parser.parse(pattern))


class PatternSet:
    """Patterns with the automaton that says which of them to try. ``texts`` they are tried on are in lower case."""

    def __init__(self, patterns: tuple[str, ...]):
        capitals = lambda p: re.search("[A-Z]", re.sub(r"\\.", "", p)) is not None
        self.compiled = [re.compile(p, re.IGNORECASE if capitals(p) else 0) for p in patterns]
        of: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, p in enumerate(patterns):
            own = needles(p)
            for word in own:
                of.setdefault(word, []).append(k)
            if not own:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for word, ids in of.items():
            self.automaton.add_word(word, (len(word), tuple(ids)))
        if of:
            self.automaton.make_automaton()
        self.empty = not of

    def hits(self, text: str):
        """(end, (length, patterns)) of every needle in a text, by end."""
        return () if self.empty or not text else self.automaton.iter(text)


@lru_cache(maxsize=8)
def pattern_set(patterns: tuple[str, ...]) -> PatternSet:
    return PatternSet(patterns)


class ClauseReader:
    """Cuts texts into clauses and finds what is negated in them."""

    def __init__(self, sentence_end: str, contrast: str, subclause: str, negation: tuple[str, ...], not_negation: tuple[str, ...], stop: str, reach: int):
        self.sentence_end, self.contrast, self.subclause = map(re.compile, (sentence_end, contrast, subclause))
        self.cue, self.blocked, self.stop, self.reach = re.compile("|".join(negation)), re.compile("|".join(not_negation)), re.compile(stop), reach
        self.cues = pattern_set(("|".join(negation),))

    def clauses(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, text, marker) of each clause: what lies between two borders, without blanks and leading commas."""
        borders = [(m.end(), "", m.start()) for m in self.sentence_end.finditer(text)]
        borders += [(m.start(), m[0], m.start()) for m in self.contrast.finditer(text)]
        borders += [(m.end(), "", m.end()) for m in self.subclause.finditer(text)]
        borders.sort()
        out = []
        for (low, marker, _), (*_, high) in zip([(0, "", 0), *borders], [*borders, (0, "", len(text))]):
            whole = text[low:high]
            own = whole.lstrip(" ,")
            start, own = low + len(whole) - len(own), own.rstrip()
            if own:
                out.append((start, start + len(own), own, marker))
        return out

    def scopes(self, clause: str) -> list[Span]:
        """Stretches of a clause under negation: from a cue to the next stop, ``reach`` signs at most; those that meet are one."""
        if not self.cues.always and next(iter(self.cues.hits(clause)), None) is None:
            return []
        spared = [m.span() for m in self.blocked.finditer(clause)]
        stops = [m.start() for m in self.stop.finditer(clause)]
        out: list[Span] = []
        for m in self.cue.finditer(clause):
            if inside(spared, m.start()):
                continue
            at = bisect_left(stops, m.end())
            end = min(stops[at] if at < len(stops) else len(clause), m.end() + self.reach)
            if out and m.end() <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            elif end > m.end():
                out.append((m.end(), end))
        return out


def inside(spans: list[Span], at: int) -> bool:
    """Whether a place lies in one of some sorted spans that do not overlap."""
    k = bisect_right(spans, (at, float("inf"))) - 1
    return k >= 0 and at < spans[k][1]


class Reading:
    """What is found in the texts of a batch, as flat columns."""

    def __init__(self, reader: ClauseReader, of_clauses: PatternSet, of_texts: PatternSet, groups: list[int | None]):
        self.reader, self.of_clauses, self.of_texts, self.groups = reader, of_clauses, of_texts, groups
        self.clause = [[], [], [], []]
        self.neg = [[], []]
        self.place = [[], [], [], [], [], []]
        self.first = [[], [], [], [], []]
        self.ends: dict[str, list[int]] = {k: [0] for k in ("clauses", "neg", "places", "firsts")}

    def add(self, text: str) -> None:
        clauses = self.reader.clauses(text)
        starts = [c[0] for c in clauses]
        scopes = [self.reader.scopes(c[2]) for c in clauses]
        for column, values in zip(self.clause, zip(*clauses) if clauses else ((),) * 4):
            column += values
        for own in scopes:
            self.neg[0] += [s for s, _ in own]
            self.neg[1] += [e for _, e in own]
            self.ends["neg"].append(len(self.neg[0]))

        tried = {(c, k) for c in range(len(clauses)) for k in self.of_clauses.always}
        c = 0
        for end, (length, ids) in self.of_clauses.hits(text):
            while c < len(clauses) and clauses[c][1] <= end:
                c += 1
            if c < len(clauses) and clauses[c][0] <= end + 1 - length:
                tried.update((c, k) for k in ids)
        for c, k in sorted(tried):
            for nth, m in enumerate(self.of_clauses.compiled[k].finditer(clauses[c][2])):
                for column, value in zip(self.place, (k, nth, m.start(), m.end(), c, inside(scopes[c], m.start()))):
                    column.append(value)

        for k in sorted({k for _, (_, ids) in self.of_texts.hits(text) for k in ids}.union(self.of_texts.always)):
            if m := self.of_texts.compiled[k].search(text):
                c = bisect_right(starts, m.start()) - 1
                negated = c >= 0 and m.start() < clauses[c][1] and inside(scopes[c], m.start() - starts[c])
                number = m.group(self.groups[k]) if self.groups[k] is not None else None
                for column, value in zip(self.first, (k, m.start(), m.end(), number, negated)):
                    column.append(value)
        for name, column in (("clauses", self.clause[0]), ("places", self.place[0]), ("firsts", self.first[0])):
            self.ends[name].append(len(column))

    def clause_array(self) -> pa.Array:
        """array<struct<text, start, end, operative, marker, neg>> of each text."""
        start, end, text, marker = self.clause
        neg = structs({"s": (self.neg[0], pa.int32()), "e": (self.neg[1], pa.int32())}, self.ends["neg"])
        columns = [pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([m != "" for m in marker], pa.bool_()), pa.array(marker, pa.string()), neg]
        return pa.ListArray.from_arrays(pa.array(self.ends["clauses"], pa.int32()), pa.StructArray.from_arrays(columns, ["text", "start", "end", "operative", "marker", "neg"]))

    def place_array(self) -> pa.Array:
        """array<struct<pattern, nth, s, e, clause, negated>> of each text, by clause and pattern; places count within the clause."""
        return structs({n: (v, pa.bool_() if n == "negated" else pa.int32()) for n, v in zip(("pattern", "nth", "s", "e", "clause", "negated"), self.place)}, self.ends["places"])

    def first_array(self) -> pa.Array:
        """array<struct<pattern, s, e, number, negated>> of each text: the first place of every pattern that occurs."""
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
        return structs({n: (v, t) for n, v, t in zip(("pattern", "s", "e", "number", "negated"), self.first, kinds)}, self.ends["firsts"])


def structs(columns: dict[str, tuple[list, pa.DataType]], ends: list[int]) -> pa.Array:
    values = pa.StructArray.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
