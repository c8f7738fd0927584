import math
import random
from collections import defaultdict
from itertools import product

import numpy as np

from driftnet.operators import events


def test_steps_of_each_kind(spark):
    #  1 and 2 merge to 3; 4 splits to 5 and 6; 7, 8 and 9, 10 are mixed
    edges = spark.createDataFrame([(1, 3, 5), (2, 3, 9), (4, 5, 3), (4, 6, 6), (7, 9, 4), (7, 10, 4), (8, 10, 4)], "fr int, to int, dist int")
    times = {1: (0, 10), 2: (0, 6), 3: (15, 20), 4: (0, 10), 5: (13, 20), 6: (16, 20), 7: (0, 10), 8: (0, 12), 9: (14, 20), 10: (16, 20)}
    segs = spark.createDataFrame([(s, a, b) for s, (a, b) in times.items()], "seg int, t_start int, t_end int")
    found = events.segment_events(edges)
    assert {(r.state, r.event, tuple(r.ins), tuple(r.outs)) for r in found.collect()} == {("merge", "1,2>3", (1, 2), (3,)), ("split", "4>5,6", (4,), (5, 6)), ("mixed", "7,8>9,10", (7, 8), (9, 10))}
    got = defaultdict(dict)
    for r in events.event_steps(events.event_bounds(found, segs)).collect():
        got[r.state][r.t] = r.active
    assert got["merge"] == {t: [2] if t <= 10 else [1, 2] for t in range(7, 15)}
    assert got["split"] == {t: [5, 6] if t < 13 else [6] for t in range(11, 16)}
    assert got["mixed"] == {t: [7] if t <= 12 else [7, 8] for t in range(11, 17)}
    close = segs.withColumn("t_end", segs["t_start"]).where("seg < 4").replace({15: 1}, subset=["t_start", "t_end"])
    assert events.event_steps(events.event_bounds(found.where("state = 'merge'"), close)).count() == 0  # nothing between


def test_event_nodes_against_a_search(spark):
    rng = random.Random(12)
    nodes = {i: rng.randint(0, 12) for i in range(160)}
    links = [(a, b) for a in nodes for b in nodes if nodes[b] - nodes[a] == 1 and rng.random() < 0.07]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    stray = {n for n in nodes if rng.random() < 0.8}
    spans = {e: (a, a + rng.randint(0, 6)) for e, a in ((f"e{k}", rng.randint(0, 8)) for k in range(12))}
    starts = {e: rng.sample(range(160), rng.randint(1, 3)) for e in spans}
    want = set()
    for e, (a, b) in spans.items():
        inside, todo, seen = {n for n in stray if a <= nodes[n] <= b}, list(starts[e]), set(starts[e])
        while todo:
            todo = [y for x in todo for y in near[x] & inside if y not in seen and not seen.add(y)]
        want |= {(e, n) for n in seen & inside}
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = events.event_nodes(
        frame([(e, n) for e, x in starts.items() for n in x], "event string, node int"), frame([(e, a, b) for e, (a, b) in spans.items()], "event string, t_from int, t_to int"),
        frame([(n, nodes[n]) for n in stray], "node int, t int"), frame([*links, (None, 3), *links[:5]], "src int, dst int"),
    )
    found = [(r.event, r.node) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def slow_deal(contours, told, most_far, most_unlike):
    """The best deal, one at a time."""
    n, m = len(contours), len(told)
    rated = []
    for deal in product(range(max(m, 2)), repeat=n):
        groups = [[c for c, d in zip(contours, deal, strict=True) if d == k] for k in range(m)]
        if not all(groups):
            continue
        far, unlike = [], []
        for own, (x, y, area) in zip(groups, told, strict=True):
            total = sum(c[2] for c in own)
            far.append(math.hypot(sum(c[0] * c[2] for c in own) / total - x, sum(c[1] * c[2] for c in own) / total - y))
            unlike.append(abs(area - total) / area)
        ok = [a < b and c < d for a, b, c, d in zip(far, most_far, unlike, most_unlike, strict=True)]
        rated.append((0 if all(ok) else 1 if any(ok) else 2, deal, [*far, *unlike]))
    tier = min(r[0] for r in rated)
    if tier == 2:
        return None
    mine = [r for r in rated if r[0] == tier]
    ends = [(min(c), max(c)) for c in zip(*(r[2] for r in mine), strict=True)]
    score = lambda r: round(sum((v - a) / (b - a) if b > a else 0 for v, (a, b) in zip(r[2], ends, strict=True)) / len(ends), 6)
    return min(mine, key=lambda r: (score(r), r[1]))[1]


def test_best_deal_against_one_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    seen = set()
    for trial in range(120):
        monkeypatch.setattr(events, "CHUNK", int(rng.choice([3, 64, 1 << 15])))
        m = int(rng.integers(1, 4))
        contours = np.column_stack([rng.uniform(0, 40, (n := int(rng.integers(m, 6)), 2)), rng.uniform(5, 20, n)])
        told = np.column_stack([rng.uniform(0, 40, (m, 2)), rng.uniform(10, 40, m)])
        far, unlike = rng.uniform(5, 25, m), rng.uniform(0.3, 1.2, m)
        want, got = slow_deal(contours.tolist(), told.tolist(), far, unlike), events.best_deal(contours, told, far, unlike)
        seen.add(want is None)
        assert (got is None) == (want is None) and (got is None or tuple(got[0]) == want), trial
    assert seen == {True, False}


def test_twenty_contours_are_dealt_in_bounded_memory():
    rng = np.random.default_rng(1)
    contours = np.column_stack([np.r_[rng.normal(0, 2, 10), rng.normal(100, 2, 10)], rng.normal(0, 2, 20), rng.uniform(5, 6, 20)])
    areas = [contours[:10, 2].sum(), contours[10:, 2].sum()]
    found, _ = events.best_deal(contours, np.array([[0, 0, areas[0]], [100, 0, areas[1]]]), np.full(2, 5.0), np.full(2, 0.35))
    assert found.tolist() == [0] * 10 + [1] * 10


def test_extension_to_targets(spark):
    """Two branches go on through steps in which one is in two pieces; one reaches its target, the other runs into a target of more contours; a third has no contours near."""
    known = [("e", b, t, 10.0 * t, 50.0 * b, 20.0) for b in (1, 2) for t in range(3)] + [("f", 9, t, 5.0 * t, 0.0, 10.0) for t in range(3)]
    pool = []
    for t in (3, 4, 5):
        pool += [("e", t, 11, 10.0 * t - 3, 50.0, 10.0), ("e", t, 12, 10.0 * t + 3, 50.0, 10.0), ("e", t, 21, 10.0 * t, 100.0, 20.0), ("f", t, 31, 500.0, 500.0, 10.0)]
    ends = [("e", 71, 5, [12, 11]), ("e", 72, 4, [21, 99])]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    branches = frame(known, "event string, branch int, t int, x double, y double, area double")
    contours = frame([*pool, ("g", 1, 1, 0.0, 0.0, 1.0)], "event string, t int, id int, x double, y double, area double")
    targets = frame(ends, "event string, target int, t int, ids array<int>")
    got = {(r.event, r.branch, r.t): (r.ids, r.hit, r.target) for r in events.extend_branches(branches, contours, targets).collect()}
    assert got == {("e", 1, 3): ([11, 12], None, None), ("e", 2, 3): ([21], None, None), ("e", 1, 4): ([11, 12], None, None), ("e", 2, 4): ([21], "partial", 72), ("e", 1, 5): ([11, 12], "full", 71)}
    free = {(r.event, r.branch, r.t): r.ids for r in events.extend_branches(branches, contours).collect()}
    assert free == {("e", b, t): ids for b, ids in ((1, [11, 12]), (2, [21])) for t in (3, 4, 5)}
    late = branches.where("branch = 1").unionByName(branches.where("branch = 2").selectExpr("event", "branch", "t + 2 AS t", "x + 20 AS x", "y", "area"))
    assert sorted((r.branch, r.t) for r in events.extend_branches(late, contours.where("event = 'e'")).collect() if r.branch == 2) == [(2, 5)]  # known up to step 4
