"""The sparse assignment against dense ones, enumeration and a large part."""

import itertools
import random
import time

import pytest

from tracklore.operators import assign


def every(pairs):
    """All matchings of `pairs`, as positions."""
    for n in range(len(pairs) + 1):
        for some in itertools.combinations(range(len(pairs)), n):
            if len({pairs[k][0] for k in some}) == len({pairs[k][1] for k in some}) == n:
                yield some


@pytest.mark.parametrize("seed", range(30))
def test_dense_costs_of_any_sign(seed):
    r = random.Random(seed)
    n, m = r.randint(1, 5), r.randint(1, 6)
    cost = {(i, j): r.randint(-(10**12), 10**12) for i in range(n) for j in range(m)}
    best = assign.Assignment()
    for i in range(n):
        best.add(i, [(j, cost[i, j]) for j in range(m)], 10**14)
        rows = range(i + 1)
        want = min(sum(cost[x, y] for x, y in zip(some, p)) for k in [min(i + 1, m)] for some in itertools.combinations(rows, k) for p in itertools.permutations(range(m), k))
        assert len(best.pairs()) == min(i + 1, m) and sum(cost[x] for x in best.pairs()) == want  # after each row


@pytest.mark.parametrize("seed", range(30))
def test_weights_and_levels_equal_enumeration(seed):
    r = random.Random(seed)
    pairs = sorted({(f"r{r.randrange(5)}", f"h{r.randrange(5)}") for _ in range(r.randint(1, 11))})
    cost = [r.randrange(1000) << 20 | r.getrandbits(20) for _ in pairs]
    total = lambda some: sum(cost[k] for k in some)
    assert total(assign.best_weight(pairs, cost)) == max(map(total, every(pairs)))
    level = {h: r.randrange(4) for _, h in pairs}
    top = max(level.values())
    got = assign.assigned_by_level(pairs, cost, level)
    for at, some in zip(range(top, -1, -1), got, strict=True):
        kept = [k for k, (_, h) in enumerate(pairs) if level[h] >= at]
        assert some == [kept[i] for i in assign.assigned([pairs[k] for k in kept], [cost[k] for k in kept])]
        best = min(every([pairs[k] for k in kept]), key=lambda x: (-len(x), sum(cost[kept[i]] for i in x)))
        assert some == [kept[i] for i in best]


@pytest.mark.parametrize("cost", list(itertools.permutations([5, 1, 3])))
def test_of_a_repeated_pair_the_cheapest_matches(cost):
    pairs = [("r", "h")] * 3
    assert assign.assigned(pairs, list(cost)) == [cost.index(1)] and assign.best_weight(pairs, list(cost)) == [cost.index(5)]
    assert assign.assigned_by_level(pairs, list(cost), {"h": 1}) == [[cost.index(1)]] * 2


def test_a_part_of_twenty_thousand_events():
    r = random.Random(1)
    n = 10_000
    pairs = sorted({(i, max(0, min(n - 1, i + r.randint(-9, 9)))) for i in range(n) for _ in range(13)})
    pairs += [(n + i, r.randrange(n)) for i in range(2000)]  # more refs than can match
    cost = [r.randrange(1 << 40) for _ in pairs]
    began = time.time()
    got = assign.assigned(pairs, cost)
    assert time.time() - began < 60
    assert len(pairs) > 90_000 and len({pairs[k][0] for k in got}) == len({pairs[k][1] for k in got}) == len(got)
    # no swap of two neighbours is cheaper, and no free pair is left
    at = {p: c for p, c in zip(pairs, cost)}
    refs, hyps = ({pairs[k][side] for k in got} for side in (0, 1))
    assert not any(x not in refs and y not in hyps for x, y in pairs)
    chosen = [pairs[k] for k in got]
    by_hyp = {y: x for x, y in chosen}
    for x, y in chosen:
        for z in range(y - 9, y + 10):
            other = by_hyp.get(z)
            if (x, z) in at and (other, y) in at:
                assert at[x, y] + at[other, z] <= at[x, z] + at[other, y]
