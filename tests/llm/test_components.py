"""Connected components against a plain union-find."""

import random

import pytest

from intakespark.llm._tables import Scratch
from intakespark.llm.components import connected_components


def plain(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def chance(seed):
    rng = random.Random(seed)
    return [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]


CASES = {
    "none": [],
    "self, null and repeated": [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (5, 4)],
    "hub is smallest": [(0, k) for k in range(1, 60)],
    "hub is largest": [(99, k) for k in range(60)],
    "path": [(k, k + 1) for k in range(70)],
    "shuffled path": [((37 * k) % 101, (37 * (k + 1)) % 101) for k in range(100)],
    "two hubs that share": [(1, k) for k in range(10, 30)] + [(2, k) for k in range(29, 50)],
    "chance": chance(3),
}


@pytest.mark.parametrize("name", CASES)
def test_against_union_find(spark, name):
    links = spark.createDataFrame(CASES[name], "u long, v long")
    got = connected_components(links, Scratch(spark, "test")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == plain(CASES[name])
