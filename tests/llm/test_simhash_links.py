"""SimHash links beyond the registered query: shared ids, odd thresholds."""

import random

import pytest

from runweave.llm import simhash
from runweave.llm.common import prepare
from tests_support import brute_fingerprint, components_of


def test_shared_ids_tie_nothing(spark):
    """An unrelated text under a near copy's doc_id, or under a null one, keeps a component of its own."""
    prepare(spark)
    say = lambda c: " ".join(f"{c}{i}" for i in range(600))
    b, c = say("b"), say("c")
    near = b + " end"
    assert 0 < (brute_fingerprint(b, 5) ^ brute_fingerprint(near, 5)).bit_count() <= 4
    for shared, want in ((5, [(3, 3), (5, 3), (5, 5), (9, 5)]), (None, [(-1, -1), (-1, -1), (3, -1), (9, -1)])):
        docs = spark.createDataFrame([(shared, b), (3, near), (shared, c), (9, c)], "doc_id bigint, text string")
        found = simhash.near_duplicates(docs).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in found) == want


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_crowded_values_below_four_bits(spark, tau):
    prepare(spark)
    rng = random.Random(tau)
    prints = sorted({sum(1 << b for b in rng.sample(range(63), 4)) for _ in range(60)})
    for fp in list(prints[:30]):
        prints.append(fp ^ sum(1 << b for b in rng.sample(range(63), tau)))
    prints = sorted(set(prints))
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp bigint"), tau, 1, 2).collect()
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        x, y = find(r.a), find(r.b)
        root[max(x, y)] = min(x, y)
    assert {x: find(x) for x in prints} == components_of({x: x for x in prints}, tau)
