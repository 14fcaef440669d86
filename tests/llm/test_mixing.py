import hashlib
import random
import re

import pytest

from murmur.llm import mixing
from tests.llm.util import frame


def targets(sizes, weights=(5, 2, 1), copies=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * share >= copies * sizes[s]]
        if not over:
            return {s: float(fixed[s]) if s in fixed else weight[s] * share for s in names}
        fixed.update({s: copies * sizes[s] for s in over})


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sums = {}
    for (_, _, s), n in zip(rows, size):
        sums[s] = sums.get(s, 0) + n
    goal = targets(sums)
    queue, cum = [], {}
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(str(rows[k][0]).encode()).hexdigest(), rows[k][0], size[k]))
    for k in order:
        s = rows[k][2]
        cum[s] = cum.get(s, 0) + size[k]
        if size[k] and goal[s]:
            queue += [((cum[s] + e * sums[s]) / goal[s], k, e) for e in range(3)]
    taken, used = [0] * len(rows), 0
    for _, k, _ in sorted(queue):
        used += size[k]
        if used > sum(size):
            break
        taken[k] += size[k]
    return [(rows[k][0], size[k], sums[rows[k][2]], goal[rows[k][2]], taken[k]) for k in range(len(rows))]


def run(df):
    return [tuple(r) for r in mixing.mix(df).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_queue(spark, seed):
    r = random.Random(seed)
    rows = [(k, " w\n" * r.randrange(0, 60), r.choice(["a", "a", "a", "b", "é", "Z", None, "tiny" if k < 40 else "a"])) for k in range(600)]
    rows += [(1001, None, "a"), (1002, "", "none at all"), (1003, "x " * 3000, "b")]
    got, want = sorted(run(frame(spark, rows))), sorted(brute(rows))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) <= 1e-9 * max(1, w[3]) for g, w in zip(got, want))
    assert sorted(run(frame(spark, rows).repartition(7))) == got


def test_odd_tables(spark):
    assert run(frame(spark, []).limit(0)) == []
    rows = [(1, None, None), (2, "", "s")]
    assert sorted(run(frame(spark, rows))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    same = [(5, "a b c", "s")] * 4 + [(None, "a b", "s")]
    got = run(frame(spark, same).selectExpr("*", "1 as size", "2 as target", "3 as key", "4 as hash"))
    assert len(got) == 5 and sum(g[4] for g in got) <= 14 and {g[4] for g in got} <= {0, 2, 3, 4, 6}


def test_sources_come_near_their_targets(spark):
    rows = [(k, "w " * (20 + k % 30), f"src{k % 5}" if k % 3 else "src0") for k in range(3000)]
    got = run(frame(spark, rows))
    by = {}
    for (_, _, s), g in zip(sorted(rows), sorted(got)):
        t, n = by.get(s, (g[3], 0))
        by[s] = (t, n + g[4])
    assert all(abs(n - t) <= 60 for t, n in by.values())
    assert all(g[4] <= 3 * g[1] for g in got)


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(frame(spark, [(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
