"""Tracking stages, as rewrites of tables instead of changes to a graph in place.

nodes: (t, id, x, y, w, h); segment nodes: (seg, t, ids); segment edges: (fr, to, dist).
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftnet.functions.geometry import expand_box, union_box
from driftnet.operators.combi import power_set
from driftnet.operators.graph import box_families, connected_components, families, one_to_one_chains, reachable
from driftnet.operators.joins import near_another, overlap_join
from driftnet.operators.score import WEIGHTS
from driftnet.operators.series import frozen
from driftnet.storage import settle


def first_pass(boxes: DataFrame, side: int = 100) -> DataFrame:
    """(t, cluster, ids, x, y, w, h): boxes of a frame that touch once grown to ``side``, with the box around each cluster."""
    grown = boxes.withColumns(expand_box(side))
    found = box_families(grown)
    met = boxes.join(found.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    ids = met.groupBy("t", "cluster").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return union_box(met, ("t", "cluster")).join(ids, ["t", "cluster"])


def sequence_families(clusters: DataFrame) -> DataFrame:
    """(node, component): families of clusters (t, id, box) that touch from a frame to the next."""
    pairs = overlap_join(clusters, clusters, 1).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    return families(pairs, clusters, "id")


def remove_frozen(tracks: DataFrame, most: float = 5.0, radius: float = 5.0, single: bool = False, key: str = "obj") -> DataFrame:
    """The tracks without those that stand still; one alone stays unless ``single``."""
    still = frozen(tracks, most, key)
    gone = still.select(key) if single else near_another(still.withColumnRenamed(key, "id"), radius).withColumnRenamed("id", key)
    return tracks.join(gone.distinct(), key, "left_anti")


def stray_web(edges: DataFrame, stray: DataFrame, links: DataFrame) -> DataFrame:
    """(fr, to, t, ids): for each segment edge (fr, to, fr_node, to_node, t_end, t_start), the stray nodes (node, t) strictly between in time
    that hang together with its first node over ``links`` (src, dst), by time."""
    between = edges.join(stray, F.expr("t > t_end AND t < t_start")) if "k" not in stray.columns else edges.join(stray, "k").where("t > t_end AND t < t_start")
    inside = between.select("fr", "to", F.col("node"), "t").unionByName(edges.select("fr", "to", F.col("fr_node").alias("node"), F.col("t_end").alias("t"))).unionByName(edges.select("fr", "to", F.col("to_node").alias("node"), F.col("t_start").alias("t")))
    key = lambda c: F.struct("fr", "to", F.col(c).alias("node"))
    a, b = inside.select("fr", "to", F.col("node").alias("src")), inside.select("fr", "to", F.col("node").alias("dst"))
    local = links.join(a, "src").join(b, ["fr", "to", "dst"]).select(key("src").alias("src"), key("dst").alias("dst"))
    found = connected_components(local)
    mine = edges.select("fr", "to", F.struct("fr", "to", F.col("fr_node").alias("node")).alias("node")).join(found, "node").select("fr", "to", "component")
    hit = found.select("component", F.col("node.fr").alias("fr"), F.col("node.to").alias("to"), F.col("node.node").alias("node")).join(mine, ["fr", "to", "component"], "left_semi")
    return hit.join(inside, ["fr", "to", "node"]).where("TRUE").groupBy("fr", "to", "t").agg(F.array_sort(F.collect_set("node")).alias("ids"))


def cut_for_zero_path(segment_nodes: DataFrame, edges: DataFrame, buffer: int = 5) -> DataFrame:
    """Each solo_zp edge with the nodes up to ``buffer`` steps on both its sides, which are freed to be joined anew: (fr, to, t, ids)."""
    met = edges.select("fr", "to", "t_end", "t_start")
    a = met.join(segment_nodes.select(F.col("seg").alias("fr"), "t", "ids"), "fr").where(F.expr(f"t > t_end - {buffer}"))
    b = met.join(segment_nodes.select(F.col("seg").alias("to"), "t", "ids"), "to").where(F.expr(f"t < t_start + {buffer}"))
    return a.select("fr", "to", "t", "ids").unionByName(b.select("fr", "to", "t", "ids"))


def save_connection(segment_nodes: DataFrame, filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segment nodes in which each connected pair is one segment, with the composite nodes ``filled`` (fr, to, t, ids) between; and who
    inherits whom (slave, master): the name of a row of connected segments is its smallest."""
    pairs = filled.select("fr", "to").distinct()
    named = connected_components(pairs, "fr", "to").select(F.col("node").alias("slave"), F.col("component").alias("master"))
    moved = segment_nodes.join(named.withColumnRenamed("slave", "seg"), "seg", "left").select(F.coalesce("master", "seg").alias("seg"), "t", "ids")
    inner = filled.join(named.withColumnRenamed("slave", "fr"), "fr").select(F.col("master").alias("seg"), "t", "ids")
    rewritten = inner.unionByName(moved.join(inner.select("seg", "t"), ["seg", "t"], "left_anti"))
    return rewritten, named


def save_extension(segment_nodes: DataFrame, extension: DataFrame) -> DataFrame:
    """Segment nodes with composite nodes ``extension`` (seg, t, ids) added at either end; a time that a segment has stays as it is."""
    return segment_nodes.unionByName(extension.join(segment_nodes.select("seg", "t"), ["seg", "t"], "left_anti").select("seg", "t", "ids"))


def event_info(events: DataFrame, segments: DataFrame, stray: DataFrame) -> DataFrame:
    """For each event (event, ins, outs): its steps from the first end of its in-branches to the last start of its out-branches, the branches that
    are active at each and the stray ids there: (event, t, active, ids)."""
    parts = events.select("event", F.explode(F.array_union("ins", "outs")).alias("seg"), "ins").withColumn("enters", F.expr("array_contains(ins, seg)"))
    met = parts.join(segments.select("seg", "t_start", "t_end"), "seg")
    ends = met.groupBy("event").agg(F.min(F.expr("CASE WHEN enters THEN t_end END")).alias("a"), F.max(F.expr("CASE WHEN NOT enters THEN t_start END")).alias("b"))
    times = ends.where("a <= b").select("event", F.explode(F.sequence("a", "b")).alias("t"))
    active = times.join(met.select("event", "seg", "t_start", "t_end"), "event").groupBy("event", "t").agg(F.array_sort(F.collect_set(F.expr("CASE WHEN t BETWEEN t_start AND t_end THEN seg END"))).alias("active"))
    pool = stray.groupBy("t").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return active.join(pool, "t", "left").select("event", "t", "active", F.coalesce("ids", F.array().cast(pool.schema["ids"].dataType)).alias("ids"))


def terminal_extension(ends: DataFrame, links: DataFrame, steps: int = 20) -> DataFrame:
    """(seg, node, depth): nodes within ``steps`` links of each segment's end (seg, node)."""
    found = reachable(links, ends.select(F.col("node").alias("start")), steps)
    return ends.join(found.withColumnRenamed("node", "reached"), ends["node"] == found["start"]).select("seg", F.col("reached").alias("node"), "depth")


def extrapolate_branches(events: DataFrame, branches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(event, branch, t, ids, accepted): step by step, every active branch is extrapolated and the contours of the step are dealt among them.

    branches: (event, branch, t, x, y, area), up to three last known steps. candidates: (event, t, id, x, y, area). The deal of least mean of
    scaled distance and relative area wins; a single branch may leave contours out, so all non-empty subsets are tried. All deals are
    rated, so a step's work grows as branches to the power of contours; a branch whose distance passes max(5, mean) + 5 deviations goes on, another stops. Events are
    independent and run in parallel; within one the steps follow each other. With fewer contours than branches all stop.
    """

    def one(known: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if known.empty or found.empty:
            return pd.DataFrame(out, columns=["event", "branch", "t", "ids", "accepted"]).astype({"event": "int64", "branch": "int64", "t": "int32", "accepted": bool})
        event = int(known["event"].iloc[0])
        history = {b: g.sort_values("t")[["x", "y", "area"]].to_numpy(float)[-3:].tolist() for b, g in known.groupby("branch")}
        errors: dict[int, list[float]] = {b: [] for b in history}
        active = sorted(history)
        for t, g in sorted(found.groupby("t"), key=lambda k: k[0]):
            items = g.sort_values("id")[["id", "x", "y", "area"]].to_numpy(float)
            if not active or len(items) < len(active):
                break
            told = {b: np.array(h[-1]) + (np.array(h[-1]) - np.array(h[-2]) if len(h) > 1 else 0) for b, h in ((b, history[b]) for b in active)}
            rated = []
            # a deal has each contour's branch; one beyond the active branches leaves the contour out
            for deal in product(range(max(len(active), 2)), repeat=len(items)):
                if not set(range(len(active))) <= set(deal):
                    continue
                d, a, groups = 0.0, 0.0, []
                for k, b in enumerate(active):
                    own = items[[i for i, x in enumerate(deal) if x == k]]
                    area = own[:, 3].sum()
                    c = (own[:, 1:3] * own[:, 3:]).sum(0) / max(area, 1e-9)
                    gap = float(np.hypot(*(c - told[b][:2])))
                    d, a = d + gap, a + abs(area - history[b][-1][2]) / max(history[b][-1][2], 1e-9)
                    groups.append((b, own[:, 0].astype(int).tolist(), c, area, gap))
                rated.append((d, a, groups))
            if not rated:
                break
            lo, hi = np.min([r[:2] for r in rated], axis=0), np.max([r[:2] for r in rated], axis=0)
            width = np.where(hi > lo, hi - lo, 1)
            best = min(rated, key=lambda r: (round(float((((np.array(r[:2]) - lo) / width).mean())), 9), [x[1] for x in r[2]]))
            going = []
            for b, ids, c, area, gap in best[2]:
                e = errors[b]
                passed = gap <= max(float(np.mean(e)) if e else 0.0, 5.0) + 5 * (float(np.std(e)) if e else 3.0)
                out.append((event, int(b), int(t), ids, bool(passed)))
                if passed:
                    e.append(gap)
                    history[b] = [*history[b][-2:], [*c.tolist(), area]]
                    going.append(b)
            active = going
        return pd.DataFrame(out, columns=["event", "branch", "t", "ids", "accepted"])

    kind = "event long, branch long, t int, ids array<long>, accepted boolean"
    anew = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  # the tables may come of one
    known = anew(branches, "event", "branch", "t", "x", "y", "area").join(anew(events, "event"), "event", "left_semi")
    return anew(known, *known.columns).groupBy("event").cogroup(anew(candidates, "event", "t", "id", "x", "y", "area").groupBy("event")).applyInPandas(one, kind)


def recompute_segments(links: DataFrame, old: DataFrame) -> DataFrame:
    """(node, seg): one-to-one chains of links anew; a chain that holds an old segment's first node (seg, node) keeps its name, others get
    their smallest node's."""
    chains = one_to_one_chains(links)
    named = old.join(chains, "node").groupBy("chain").agg(F.min("seg").alias("seg"))
    return chains.join(named, "chain", "left").select("node", F.coalesce(F.col("seg").cast("string"), F.concat(F.lit("new "), F.col("chain").cast("string"))).alias("seg"))


def merges_of_frames(old: DataFrame, new: DataFrame, small: float = 0.3) -> DataFrame:
    """(new, olds, heir): new boxes that touch several old ones; of a big and small ones (area under ``small`` of it) the big one's id is inherited."""
    pairs = overlap_join(old, new, 1).select(F.col("id_a").alias("old"), F.col("id_b").alias("new"), F.expr("w * h").alias("area"))
    g = pairs.groupBy("new").agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), F.col("old").alias("o")))).alias("l")).where(F.size("l") > 1)
    heir = F.when(F.expr(f"l[1].a >= {small} * l[0].a"), F.expr("l[0].o"))  # areas are negative here
    return g.select("new", F.array_sort(F.transform("l", lambda x: x["o"])).alias("olds"), heir.alias("heir"))


def stuck(pairs: DataFrame, most_d: float = 3.0, most_area: float = 0.4, most_angle: float = 15.0) -> DataFrame:
    """Pairs of boxes of consecutive frames that hardly moved or changed."""
    d = "sqrt(pow((x + w / 2D) - (x_b + w_b / 2D), 2) + pow((y + h / 2D) - (y_b + h_b / 2D), 2))"
    angle = "abs(degrees(atan(h / w)) - degrees(atan(h_b / w_b)))"
    return pairs.where(F.expr(f"{d} <= {most_d} AND abs(w * h - w_b * h_b) / greatest(w * h, 1) < {most_area} AND {angle} < {most_angle}"))


def trusted_connections(edges: DataFrame, segments: DataFrame, least: int = 7) -> DataFrame:
    """Segment edges whose two segments have at least ``least`` nodes."""
    n = segments.where(F.col("n") >= least)
    return edges.join(n.select(F.col("seg").alias("fr")), "fr", "left_semi").join(n.select(F.col("seg").alias("to")), "to", "left_semi").select(*edges.columns)


def isolated_connections(paths: DataFrame, links: DataFrame) -> DataFrame:
    """The paths (path, node) none of whose nodes has a neighbour (src, dst) outside of the path."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = paths.join(both, paths["node"] == both["src"]).select("path", F.col("dst").alias("node")).distinct()
    bad = near.join(paths, ["path", "node"], "left_anti").select("path").distinct()
    return paths.select("path").distinct().join(bad, "path", "left_anti")


def position_class(edges: DataFrame, typed: DataFrame) -> DataFrame:
    """Solo edges (fr, to) by how many of their sides touch a split or merge of ``typed`` (fr, to, state): neither, one or both."""
    busy = typed.where("state IN ('split', 'merge', 'mixed', 'beside')")
    a = busy.select(F.col("to").alias("fr")).distinct().withColumn("left", F.lit(1))
    b = busy.select(F.col("fr").alias("to")).distinct().withColumn("right", F.lit(1))
    met = edges.join(a, "fr", "left").join(b, "to", "left")
    n = F.coalesce("left", F.lit(0)) + F.coalesce("right", F.lit(0))
    return met.select("fr", "to", F.element_at(F.array(F.lit("neither"), F.lit("one"), F.lit("both")), n + 1).alias("position"))


def area_conserved(edges: DataFrame, nodes: DataFrame, last: int = 4, most: float = 0.3) -> DataFrame:
    """Edges whose mean area over the last nodes of fr and the first of to differs by less than ``most``; nodes: (seg, t, area)."""
    back, ahead = Window.partitionBy("seg").orderBy(F.desc("t")), Window.partitionBy("seg").orderBy("t")
    a = nodes.withColumn("k", F.row_number().over(back)).where(F.col("k") <= last).groupBy(F.col("seg").alias("fr")).agg(F.avg("area").alias("a"))
    b = nodes.withColumn("k", F.row_number().over(ahead)).where(F.col("k") <= last).groupBy(F.col("seg").alias("to")).agg(F.avg("area").alias("b"))
    change = F.abs(F.col("a") - F.col("b")) / F.greatest("a", F.lit(1e-4))
    return edges.join(a, "fr").join(b, "to").where(change < most).select("fr", "to", F.round(change, 4).alias("change"))


def solo_time_extension(info: DataFrame, ends: DataFrame, backward: bool = True) -> DataFrame:
    """(event, t): of an event's times (event, t, ids) with one contour beyond all branch ends (event, t_end), from the nearest on, those without a gap."""
    solo = info.where(F.size("ids") == 1).join(ends, "event").where("t > t_end")
    w = Window.partitionBy("event").orderBy(F.desc("t") if backward else F.col("t"))
    step = F.row_number().over(w)
    run = solo.withColumn("run", F.col("t") + step if backward else F.col("t") - step)
    edge = F.first("run").over(w)
    return run.withColumn("edge", edge).where("run = edge").select("event", "t")


def best_reassignment(candidates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each key the candidate of greatest (1 - d / dmax) + (1 - a / amax), the smaller id on ties; from (keys, id, d, a)."""
    w = Window.partitionBy(*keys)
    unit = lambda c: 1 - F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0.0)), F.lit(0.0))
    scored = candidates.withColumn("score", F.round(unit("d") + unit("a"), 6))
    return scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("_k")).select(*keys, "_k.id", (-F.col("_k.s")).alias("score"))


# Connections between two segments


def evolutions(choices: DataFrame, most: int = 5000, change: float = 2.0) -> DataFrame:
    """(edge, evol, t, ids, x, y, area): ways to choose one subset of contours for each step, from (edge, t, ids, x, y, area).

    Up to ``most`` of them all are made. Where there would be more, steps must change the area by less than ``change``, which is widened
    to 5 if no way is left; subsets with most contours come first, and the first ``most`` ways count. If still none is left, the way of
    all contours is given. The cap is the operator's own, and an edge is one group.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(n=rows["ids"].map(len), key=rows["ids"].map(tuple)).sort_values(["t", "n", "key"], ascending=[True, False, True])
        layers = [g[["t", "ids", "x", "y", "area"]].to_dict("records") for _, g in rows.groupby("t")]
        ways: list[list[dict]] = []
        for limit in (math.inf, change, 5.0) if math.prod(map(len, layers)) <= most else (change, 5.0):
            stack = [([], 0)]
            while stack and len(ways) < most:
                way, k = stack.pop()
                if k == len(layers):
                    ways.append(way)
                    continue
                for c in reversed(layers[k]):
                    if not way or abs(c["area"] - way[-1]["area"]) / max(way[-1]["area"], 1e-4) < limit:
                        stack.append(([*way, c], k + 1))
            if ways:
                break
        ways = ways or [[x[0] for x in layers]]
        edge = int(rows["edge"].iloc[0])
        out = [(edge, i, int(c["t"]), list(map(int, c["ids"])), c["x"], c["y"], c["area"]) for i, w in enumerate(ways) for c in w]
        return pd.DataFrame(out, columns=["edge", "evol", "t", "ids", "x", "y", "area"])

    kind = "edge long, evol int, t int, ids array<long>, x double, y double, area double"
    return choices.selectExpr("CAST(edge AS BIGINT) edge", "CAST(t AS INT) t", "CAST(ids AS array<bigint>) ids", "CAST(x AS DOUBLE) x", "CAST(y AS DOUBLE) y", "CAST(area AS DOUBLE) area").groupBy("edge").applyInPandas(one, kind)


def _first_least(values: np.ndarray) -> int:
    return int(np.flatnonzero(values <= values.min() + 1e-9)[0])


def _cheapest(steps: list[np.ndarray]) -> tuple[int, ...]:
    """The path through layers of least total of ``steps`` (a matrix from each layer to the next), the first in order on ties: costs to the end, from the end back."""
    togo = [np.zeros(steps[-1].shape[1])]
    for m in reversed(steps):
        togo.append((m + togo[-1]).min(1))
    togo.reverse()
    path = [_first_least(togo[0])]
    for m, rest in zip(steps, togo[1:], strict=True):
        path.append(_first_least(m[path[-1]] + rest))
    return tuple(path)


def _nearest_to_line(places: list[np.ndarray], times: np.ndarray) -> tuple[int, ...]:
    """The path whose inner places lie nearest to the line between its own ends: for each two ends every inner step has a nearest place of its own."""
    share = (times - times[0]) / max(times[-1] - times[0], 1)
    first, last = places[0][:, None, None], places[-1][None, :, None]
    away = [np.linalg.norm(first + (last - first) * s - p[None, None], axis=-1) for s, p in zip(share[1:-1], places[1:-1], strict=True)]
    total = sum((d.min(-1) for d in away), np.zeros((len(places[0]), len(places[-1]))))
    ties = [tuple(map(int, x)) for x in np.argwhere(total <= total.min() + 1e-9)]
    return min((a, *(_first_least(d[a, b]) for d in away), b) for a, b in ties)


def best_evolutions(choices: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(edge, t, ids): of all ways to choose one subset of contours for each step, the one that the criteria vote for, from (edge, t, ids, x, y, area).

    The ways of ``evolutions`` are never made: each criterion's winner is a shortest path through the layers of subsets (displacement, change of area and of moment)
    or, for the distance to the line between its ends, a nearest place for each step and two ends. A way's votes are the weights of the criteria that it wins. So the result is the best of all
    ways, however many there are; work grows with the steps and the product of neighbouring layers' sizes. Subsets with most contours come first on ties.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(n=rows["ids"].map(len), key=rows["ids"].map(tuple)).sort_values(["t", "n", "key"], ascending=[True, False, True])
        layers = [g for _, g in rows.groupby("t")]
        times = np.array([g["t"].iloc[0] for g in layers], float)
        places, areas = [g[["x", "y"]].to_numpy(float) for g in layers], [g["area"].to_numpy(float) for g in layers]
        between = lambda f, values: [f(a, b) for a, b in zip(values, values[1:], strict=False)]
        change = lambda a, b: np.abs(a[:, None] - b[None])
        votes: dict[tuple[int, ...], float] = {}
        if len(layers) > 1:
            winners = [
                _nearest_to_line(places, times) if len(layers) > 2 else (0,) * len(layers),
                _cheapest(between(lambda a, b: np.linalg.norm(a[:, None] - b[None], axis=-1), places)),
                _cheapest(between(change, areas)),
                _cheapest(between(change, [a**2 for a in areas])),
            ]
        else:
            winners = [(0,)] * 4
        for way, weight in zip(winners, weights, strict=True):
            votes[way] = votes.get(way, 0.0) + weight
        best = min(votes, key=lambda way: (-votes[way], way))
        return pd.DataFrame({"edge": rows["edge"].iloc[0], "t": [g["t"].iloc[0] for g in layers], "ids": [list(map(int, g["ids"].iloc[i])) for g, i in zip(layers, best, strict=True)]})

    plain = choices.selectExpr("CAST(edge AS BIGINT) edge", "CAST(t AS INT) t", "CAST(ids AS array<bigint>) ids", "CAST(x AS DOUBLE) x", "CAST(y AS DOUBLE) y", "CAST(area AS DOUBLE) area")
    return plain.groupBy("edge").applyInPandas(one, "edge long, t int, ids array<long>")


def resolve_connections(web: DataFrame, contours: DataFrame, mode: str = "absorb_all", longest: int = 6) -> DataFrame:
    """(edge, t, ids): the contours that join two segments, step by step, from the stray web (edge, t, ids) and contours (t, id, x, y, area).

    ``absorb_all`` takes every contour of a step. ``best_evolution`` tries the subsets of each step (all contours only, where there are over
    ``longest``) and takes the way of them that the criteria vote for, see ``best_evolutions``.
    """
    if mode == "absorb_all":
        return web.select("edge", "t", "ids")
    subsets = web.select("edge", "t", F.explode(F.when(F.size("ids") <= longest, power_set("ids")).otherwise(F.array("ids"))).alias("ids"))
    parts = subsets.select("edge", "t", "ids", F.explode("ids").alias("id")).join(contours, ["t", "id"])
    made = parts.groupBy("edge", "t", "ids").agg((F.sum(F.col("x") * F.col("area")) / F.sum("area")).alias("x"), (F.sum(F.col("y") * F.col("area")) / F.sum("area")).alias("y"), F.sum("area").alias("area"))
    return best_evolutions(made)


def outer_iterations(segment_nodes: DataFrame, passes: list) -> DataFrame:
    """The passes (functions of the segment nodes) in turn, each on what the one before left, kept in the shared folder between."""
    for step in passes:
        segment_nodes = settle(step(segment_nodes))
    return segment_nodes


# Layout


def colour(index, n: int = 12):
    return F.pmod(index, F.lit(n)).cast("int")


def interval_layers(intervals: DataFrame, key: str = "family") -> DataFrame:
    """(family, id, layer): intervals (id, start, stop) put in the first layer that is free, in order of their start; a family is one task's rows."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "stop", "id"])
        ends: list[float] = []
        out = []
        for i, a, b in zip(rows["id"], rows["start"], rows["stop"], strict=True):
            k = next((k for k, e in enumerate(ends) if e < a), len(ends))
            ends[k:k + 1] = [b]
            out.append((rows[key].iloc[0], i, k))
        return pd.DataFrame(out, columns=[key, "id", "layer"])

    return intervals.select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), "start", "stop").groupBy(key).applyInPandas(one, f"{key} long, id long, layer int")


def oscillate(rank):
    """0, 1, -1, 2, -2, ... for ranks from 0."""
    return F.when(rank % 2 == 1, F.floor((rank + 1) / 2)).otherwise(-F.floor(rank / 2)).cast("int")


def collage_grid(n: int, w: int, h: int, ratio: float) -> tuple[int, int]:
    """(columns, rows) for n pictures w by h whose whole comes nearest to the aspect ratio."""
    return min(((c, math.ceil(n / c)) for c in range(1, n + 1)), key=lambda g: (abs(g[0] * w / (g[1] * h) - ratio), g))
