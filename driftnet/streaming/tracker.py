"""Structured Streaming forms of the stateful operators: state by object, forgotten after a bounded time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Entries kept by object, age in steps after which they go, mean distance under which an object stands still.
ENTRIES, AGE, STILL = 5, 50, 5.0


def still_objects(stream: DataFrame, entries: int = ENTRIES, age: int = AGE, most: float = STILL) -> DataFrame:
    """(obj, t, still) for a stream of positions (obj, t, x, y): as ``series.frozen_recent``, position by position.

    The state of an object is its last ``entries`` positions; within a batch positions are taken by t.
    """

    def step(key, batches, state):
        ring = list(map(tuple, state.get[0])) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, x, y in zip(rows["t"], rows["x"], rows["y"], strict=True):
            ring = [*ring, (int(t), float(x), float(y))][-entries:]
            recent = [p for p in ring if p[0] >= t - age]
            far = sum(((p[1] - recent[0][1]) ** 2 + (p[2] - recent[0][2]) ** 2) ** 0.5 for p in recent) / len(recent)
            out.append((key[0], int(t), len(recent) == entries and far < most))
        state.update(([list(p) for p in ring],))
        yield pd.DataFrame(out, columns=["obj", "t", "still"])

    return stream.groupBy("obj").applyInPandasWithState(step, "obj long, t int, still boolean", "ring array<struct<t:int,x:double,y:double>>", "append", GroupStateTimeout.NoTimeout)


def track_steps(stream: DataFrame, reach: float = 60.0, age: int = AGE) -> DataFrame:
    """(cell, t, id, track): a frame-by-frame tracker over detections (cell, t, id, x, y, area) of each cell, such as a camera or lane.

    Each step predicts the known objects by their last displacement, gives every detection in order of distance to the nearest free one
    within ``reach``, and begins new tracks with the rest. Objects not seen for ``age`` steps are forgotten.
    """

    def step(key, batches, state):
        known, last = (list(map(list, state.get[0])), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        out = []
        for t, g in rows.groupby("t", sort=True):
            known = [k for k in known if t - k[1] <= age]
            pairs = sorted((((x - k[2] - k[4]) ** 2 + (y - k[3] - k[5]) ** 2) ** 0.5, i, n) for n, k in enumerate(known) for i, x, y in zip(g["id"], g["x"], g["y"], strict=True) if k[1] < t)
            taken: dict[int, int] = {}
            for d, i, n in pairs:
                if d <= reach and i not in taken and n not in taken.values():
                    taken[i] = n
            for i, x, y in zip(g["id"], g["x"], g["y"], strict=True):
                if i in taken:
                    k = known[taken[i]]
                    k[1:] = [int(t), float(x), float(y), float(x) - k[2], float(y) - k[3]]
                    out.append((key[0], int(t), int(i), k[0]))
                else:
                    last += 1
                    known.append([last, int(t), float(x), float(y), 0.0, 0.0])
                    out.append((key[0], int(t), int(i), last))
        state.update((known, last))
        yield pd.DataFrame(out, columns=["cell", "t", "id", "track"])

    kind = "known array<struct<track:int,t:int,x:double,y:double,dx:double,dy:double>>, last int"
    return stream.groupBy("cell").applyInPandasWithState(step, "cell long, t int, id long, track int", kind, "append", GroupStateTimeout.NoTimeout)


def split_persistence(stream: DataFrame, growth: float = 5.0, apart: float = 15.0) -> DataFrame:
    """(obj, t, confirmed) for a stream of distances (obj, t, d): as ``series.split_persistence``, with the last two distances as state."""

    def step(key, batches, state):
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, d in zip(rows["t"], rows["d"], strict=True):
            ring = [*ring, float(d)][-3:]
            grown = len(ring) == 3 and (ring[0] < ring[1] < ring[2] and ring[2] - ring[0] >= growth or min(ring) >= apart)
            out.append((key[0], int(t), grown))
        state.update((ring,))
        yield pd.DataFrame(out, columns=["obj", "t", "confirmed"])

    return stream.groupBy("obj").applyInPandasWithState(step, "obj long, t int, confirmed boolean", "ring array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, mean): a stream (ts, kind, value) counted by event time; rows later than ``late`` are left out by the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "kind", "n", "mean")


def write_csv(stream: DataFrame, path: str, checkpoint: str):
    """Detections appended as CSV; a restart goes on from the checkpoint."""
    return stream.writeStream.format("csv").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
