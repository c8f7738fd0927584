"""Merges, splits and mixed events of segments: their steps, the branches to extend at each, and the stray contours that hang together with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.functions.splines import distinct_times, smoothing_spline
from driftnet.operators.graph import event_types, mixed_events
from driftnet.storage import settle, written


def segment_events(edges: DataFrame, solo_gap: int = 2) -> DataFrame:
    """(state, event, ins, outs): the classic merges and splits and the mixed events of segment edges (fr, to, dist), each named by the segments that enter and leave it."""
    typed = settle(event_types(edges, solo_gap))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    gathered = lambda state, one, many, ins, outs: typed.where(F.col("state") == state).groupBy(one).agg(F.array_sort(F.collect_set(many)).alias("many")).select(F.lit(state).alias("state"), ins.alias("ins"), outs.alias("outs"))
    merges = gathered("merge", "to", "fr", F.col("many"), F.array("to"))
    splits = gathered("split", "fr", "to", F.array("fr"), F.col("many"))
    classic = merges.unionByName(splits).withColumn("event", F.concat(text("ins"), F.lit(">"), text("outs")))
    return classic.unionByName(mixed_events(edges).withColumn("state", F.lit("mixed")).select("state", "ins", "outs", "event")).select("state", "event", "ins", "outs")


def event_bounds(events: DataFrame, segments: DataFrame) -> DataFrame:
    """(state, event, seg, enters, at, t_from, t_to): each branch of an event with the step at which its known part ends or begins, and the event's first and last step to resolve.

    A merge's steps lie between the first end of those that enter and the start of the one that leaves; a split's between the end of the one that enters and the last
    start of those that leave; a mixed event's go up to that last start, which shows whether a branch goes on in it.
    """
    sides = events.select("state", "event", F.explode(F.concat(F.transform("ins", lambda x: F.struct(x.alias("seg"), F.lit(True).alias("enters"))), F.transform("outs", lambda x: F.struct(x.alias("seg"), F.lit(False).alias("enters"))))).alias("b")).select("state", "event", "b.*")
    met = settle(sides.join(segments.select("seg", "t_start", "t_end"), "seg").withColumn("at", F.when(F.col("enters"), F.col("t_end")).otherwise(F.col("t_start"))).select("state", "event", "seg", "enters", "at"))
    ends = met.groupBy("state", "event").agg(F.min(F.when(F.col("enters"), F.col("at"))).alias("a"), F.max(F.when(~F.col("enters"), F.col("at"))).alias("b"))
    inner = ends.select("state", "event", (F.col("a") + 1).alias("t_from"), (F.col("b") - F.when(F.col("state") == "mixed", 0).otherwise(1)).alias("t_to"))
    return met.join(settle(inner.where("t_from <= t_to")), ["state", "event"])


def event_steps(bounds: DataFrame) -> DataFrame:
    """(state, event, t, active): for each step of ``event_bounds`` the branches that are to be extended into it: those that enter and have ended before, and of a split, from
    the far side, those that leave and begin after it."""
    extends = F.when(F.col("state") == "split", ~F.col("enters") & (F.col("t") < F.col("at"))).otherwise(F.col("enters") & (F.col("t") > F.col("at")))
    steps = bounds.withColumn("t", F.explode(F.sequence("t_from", "t_to")))
    return steps.groupBy("state", "event", "t").agg(F.array_sort(F.collect_set(F.when(extends, F.col("seg")))).alias("active"))


def event_nodes(starts: DataFrame, intervals: DataFrame, stray: DataFrame, links: DataFrame) -> DataFrame:
    """(event, node): for each event the ``stray`` nodes (node, t) within its interval (event, t_from, t_to) that hang together with its ``starts`` (event, node) over ``links`` (src, dst).

    All starts of an event count as connected with each other: an event with several branches needs no edge between them. Events are grown at once, a step of all their
    fronts a round, so only nodes that are reached are read; a stray node is reached by every event that it lies in. Starts themselves are not in the result unless stray.
    """
    both = written(links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").join(stray.select(F.col("node").alias("b"), "t"), "b").distinct())
    spans = settle(intervals.select("event", "t_from", "t_to"))
    front = settle(starts.select("event", "node").where("node IS NOT NULL").distinct())
    own = front.join(spans, "event").join(stray.select("node", "t"), "node").where("t BETWEEN t_from AND t_to").select("event", "node")
    seen, found = front, [written(own)]
    while not front.isEmpty():
        near = front.join(both.withColumnRenamed("a", "node"), "node").join(spans, "event").where("t BETWEEN t_from AND t_to").select("event", F.col("b").alias("node")).distinct()
        front = written(near.join(seen, ["event", "node"], "left_anti"))
        seen = written(seen.unionByName(front))
        found.append(front)
    return seen.join(starts.select("event", "node").distinct(), ["event", "node"], "left_anti").unionByName(found[0])


# Extension of branches


#: Deals rated together.
CHUNK = 1 << 15


def deals(n: int, branches: int) -> Iterator[np.ndarray]:
    """Every way to deal n contours among ``branches``, a row each, in order, none of them left without: the branch of each contour. For a single branch
    every non-empty subset, with 1 for a contour that is left out."""
    base = max(branches, 2)
    for at in range(0, base**n, CHUNK):
        number = np.arange(at, min(at + CHUNK, base**n))
        found = number[:, None] // base ** np.arange(n - 1, -1, -1) % base
        yield found[np.all([(found == k).any(1) for k in range(branches)], axis=0)]


def rate(found: np.ndarray, contours: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each deal and branch the distance of its contours' centroid from the predicted one, and the relative difference in area; contours and told: x, y, area."""
    far, unlike = np.empty((2, len(found), len(told)))
    for k, (x, y, area) in enumerate(told):
        own = found == k
        total = own @ contours[:, 2]
        centre = own @ (contours[:, :2] * contours[:, 2:]) / np.maximum(total, 1e-9)[:, None]
        far[:, k], unlike[:, k] = np.hypot(*(centre - (x, y)).T), np.abs(area - total) / max(area, 1e-9)
    return far, unlike


def best_deal(contours: np.ndarray, told: np.ndarray, most_far: np.ndarray, most_unlike: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(branch of each contour, distance of each branch) of the best deal, None if no branch of any deal passes both its gates.

    Deals of which all branches pass come before those of which some do. Among equals in this, distance and area are scaled to 0..1 for each branch over these deals, averaged, and
    the least mean over the branches wins, the first deal on ties. All deals are rated, twice and in chunks, so memory is bounded; their number is branches to the power of contours.
    """
    ends: dict[int, np.ndarray] = {}

    def tiers() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for found in deals(len(contours), len(told)):
            both = np.stack(rate(found, contours, told))
            passed = (both[0] < most_far) & (both[1] < most_unlike)
            yield found, both, np.where(passed.all(1), 0, np.where(passed.any(1), 1, 2))

    for _, both, tier in tiers():
        for k in (0, 1):
            if (tier == k).any():
                low, high = both[:, tier == k].min(1), both[:, tier == k].max(1)
                ends[k] = np.stack([np.minimum(ends[k][0], low), np.maximum(ends[k][1], high)]) if k in ends else np.stack([low, high])
    if not ends:
        return None
    k, best = min(ends), None
    low, width = ends[k][0][:, None], np.where(ends[k][1] > ends[k][0], ends[k][1] - ends[k][0], np.inf)[:, None]
    for found, both, tier in tiers():
        if (tier == k).any():
            score = np.round(((both[:, tier == k] - low) / width).mean((0, 2)), 6)
            i = int(score.argmin())
            if best is None or score[i] < best[0]:
                best = score[i], found[tier == k][i], both[0, tier == k][i]
    return best[1], best[2]


def extend_branches(branches: DataFrame, contours: DataFrame, targets: DataFrame | None = None, last: int = 3) -> DataFrame:
    """(event, branch, t, ids, hit, target): the contours that each branch of an event holds, step by step, after its known part.

    branches (event, branch, t, x, y, area) has the known part, contours (event, t, id, x, y, area) the pool of each step. At a step every branch that has begun before and has not stopped is
    predicted: its place by a spline of its last ``last`` points (degree 1, smoothing 5), its area by one brought to the width of the times (smoothing 15). The contours are dealt by
    ``best_deal``; the gates are those of ``score``: five deviations beyond the mean of the last prediction errors (at first, halves of its displacements), and of the last relative changes
    in area. A branch that keeps within the distance gate takes its contours, another stops. All stop that are met by fewer contours than they are.

    With ``targets`` (event, target, t, ids: the first nodes of those that leave a mixed event) a branch whose contours are just a target's has reached it (hit full), and one whose
    contours share some with targets runs into them (hit partial, a report, its step is not its own); both stop. Events are independent and steps follow each other; an event is one group.
    """

    def one(known: pd.DataFrame, pool: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        history = {b: g.sort_values("t")[["t", "x", "y", "area"]].to_numpy(float)[-last:] for b, g in known.groupby("branch")}
        errors = {b: np.hypot(*np.diff(h[:, 1:3], axis=0).T)[-last:] * 0.5 for b, h in history.items()}
        goals = {t: [(x.target, tuple(sorted(x.ids))) for x in g.sort_values("target").itertuples()] for t, g in ends.groupby("t")}
        stopped, out = set(), []
        for t, g in sorted(pool.groupby("t"), key=lambda k: k[0]):
            now = [b for b in sorted(history) if b not in stopped and history[b][-1, 0] < t]
            items = g.sort_values("id")
            if not now:
                continue
            if len(items) < len(now):
                stopped.update(now)
                continue
            told = np.array([_predicted(history[b], float(t)) for b in now])
            gates = [np.array([_gate(v, *g) for v in values]) for values, g in (((errors[b] for b in now), (5.0, True)), ((_changes(history[b][:, 3]) for b in now), (0.35, False)))]
            best = best_deal(items[["x", "y", "area"]].to_numpy(float), told, *gates)
            if best is None:
                stopped.update(now)
                continue
            for k, b in enumerate(now):
                own = items[best[0] == k]
                if best[1][k] >= gates[0][k]:
                    stopped.add(b)
                    continue
                ids, area = tuple(map(int, own["id"])), own["area"].sum()
                centre = (own[["x", "y"]].to_numpy(float) * own[["area"]].to_numpy(float)).sum(0) / max(area, 1e-9)
                history[b] = np.vstack([history[b], [t, *centre, area]])[-last:]
                errors[b] = np.append(errors[b], best[1][k])[-last:]
                full = next((x for x, i in goals.get(t, ()) if i == ids), None)
                part = next((x for x, i in goals.get(t, ()) if set(i) & set(ids)), None)
                out.append((b, t, list(ids), "full" if full is not None else "partial" if part is not None else None, full if full is not None else part))
                if part is not None:
                    stopped.add(b)
        event = next((x["event"].iloc[0] for x in (known, pool, ends) if len(x)), None)
        return pd.DataFrame({"event": [event] * len(out)} | {c: [r[i] for r in out] for i, c in enumerate(("branch", "t", "ids", "hit", "target"))}, dtype=object)

    kind = branches.schema["event"].dataType.simpleString()
    a = branches.select("event", F.lit(0).alias("part"), F.col("branch").cast("long").alias("branch"), F.lit(None).cast("long").alias("id"), F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area")], F.lit(None).cast("array<long>").alias("ids"))
    b = contours.select("event", F.lit(1).alias("part"), F.lit(None).cast("long").alias("branch"), F.col("id").cast("long").alias("id"), F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area")], F.lit(None).cast("array<long>").alias("ids"))
    both = a.unionByName(b)
    if targets is not None:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("x", "y", "area")]
        both = both.unionByName(targets.select("event", F.lit(2).alias("part"), F.col("target").cast("long").alias("branch"), F.lit(None).cast("long").alias("id"), F.col("t").cast("int").alias("t"), *nothing, F.array_sort(F.col("ids").cast("array<long>")).alias("ids")))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [rows[rows["part"] == k] for k in range(3)]
        return one(parts[0], parts[1].astype({"id": "int64"}), parts[2].rename(columns={"branch": "target"}))

    return both.groupBy("event").applyInPandas(split, f"event {kind}, branch long, t int, ids array<long>, hit string, target long")


def _predicted(history: np.ndarray, t: float) -> tuple[float, float, float]:
    """Place and area at t by the splines of a branch's last points."""
    times, values = distinct_times(history[:, 0], history[:, 1:])
    x, y = smoothing_spline(times, values[:, :2], 5.0, 1)(np.array([t]))[0]
    area, span = values[:, 2], max(np.ptp(times), 1.0)
    low, width = area.min(), np.ptp(area)
    told = float(smoothing_spline(times, (area - low) * span / width, 15.0, 1)(np.array([t]))[0, 0]) / span * width + low if width > 0 else float(low)
    return float(x), float(y), told


def _changes(area: np.ndarray) -> np.ndarray:
    return np.abs(np.diff(area)) / np.maximum(area[:-1], 1e-9)


def _gate(values: np.ndarray, floor: float, before: bool) -> float:
    """Five deviations beyond the mean, the floor under the mean (before) or under both."""
    mean, spread = (float(values.mean()), 5 * float(values.std())) if len(values) else (0.0, 0.0)
    return max(mean, floor) + spread if before else max(mean + spread, floor)
