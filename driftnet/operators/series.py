"""Time-series operators on tracks (obj, t, x, y, ...), as windows over one object at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftnet.functions.splines import after_three, distinct_times, smoothing_spline


def _by(key: str = "obj", time: str = "t") -> Window:
    return Window.partitionBy(key).orderBy(time)


def displacements(tracks: DataFrame, key: str = "obj", time: str = "t") -> DataFrame:
    """d: the distance to the position before; null for the first."""
    w = _by(key, time)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    return tracks.withColumn("d", F.sqrt(dx * dx + dy * dy))


def frozen(tracks: DataFrame, most: float, key: str = "obj", time: str = "t") -> DataFrame:
    """Tracks whose mean displacement is at most ``most``: mean position, mean and population deviation of the area."""
    d = displacements(tracks, key, time).groupBy(key).agg(F.avg("d").alias("d"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("area").alias("area_mean"), F.stddev_pop("area").alias("area_std"), F.count(F.lit(1)).alias("n"))
    return d.where(F.col("d") <= most)


def frozen_holes(segments: DataFrame, keys: tuple[str, ...] = ("cluster",), sigmas: float = 5) -> DataFrame:
    """Between consecutive frozen segments (seg, t_start, t_end, area_mean, area_std) of a cluster: the steps between and the band of areas."""
    w = Window.partitionBy(*keys).orderBy("seg")
    nxt = segments.withColumns({c + "_next": F.lead(c).over(w) for c in ("seg", "t_start", "area_mean", "area_std")}).where("seg_next IS NOT NULL")
    low = F.least(F.col("area_mean") - sigmas * F.col("area_std"), F.col("area_mean_next") - sigmas * F.col("area_std_next"))
    high = F.greatest(F.col("area_mean") + sigmas * F.col("area_std"), F.col("area_mean_next") + sigmas * F.col("area_std_next"))
    return nxt.select(*keys, "seg", "seg_next", (F.col("t_end") + 1).alias("t_from"), (F.col("t_start_next") - 1).alias("t_to"), low.alias("area_low"), high.alias("area_high"))


def extrapolate3(tracks: DataFrame, key: str = "obj", time: str = "t", smooth: float = 5.0, ahead: int = 1) -> DataFrame:
    """x_next, y_next: the position ``ahead`` steps on, from the last three by a linear smoothing spline of at most ``smooth`` squared error.

    In closed form: the least-squares line where its error is within ``smooth``, else the line plus the residuals shrunk by the root of the
    ratio, continued along its last piece. Null with fewer than three positions.
    """
    w = _by(key, time)
    p = {(c, k): F.lag(c, 2 - k).over(w) if k < 2 else F.col(c) for c in "xy" for k in range(3)}
    line = {c: ((p[c, 2] - p[c, 0]) / 2, (p[c, 0] + p[c, 1] + p[c, 2]) / 3) for c in "xy"}
    err = {(c, k): p[c, k] - (line[c][1] + line[c][0] * (k - 1)) for c in "xy" for k in range(3)}
    tracks = tracks.withColumns({f"_m{c}": line[c][1] for c in "xy"} | {f"_s{c}": line[c][0] for c in "xy"} | {f"_e{c}{k}": err[c, k] for c in "xy" for k in range(3)})
    total = sum((F.col(f"_e{c}{k}") ** 2 for c in "xy" for k in range(3)), F.lit(0.0))
    factor = F.when(total <= smooth, F.lit(0.0)).otherwise(1 - F.sqrt(F.lit(smooth) / total))
    out = {}
    for c in "xy":
        last = F.col(f"_m{c}") + F.col(f"_s{c}") + F.col(f"_e{c}2") * factor
        mid = F.col(f"_m{c}") + F.col(f"_e{c}1") * factor
        out[f"{c}_next"] = last + (last - mid) * ahead
    drop = [f"_{a}{c}" for a in "ms" for c in "xy"] + [f"_e{c}{k}" for c in "xy" for k in range(3)]
    return tracks.withColumns(out).drop(*drop)


def fill_holes(tracks: DataFrame, values: tuple[str, ...] = ("x", "y"), key: str = "obj", time: str = "t") -> DataFrame:
    """(obj, t, values, filled): every missing step between two known ones, on the line between them."""
    w = _by(key, time)
    nxt = tracks.select(key, time, *values, F.lead(time).over(w).alias("_t2"), *[F.lead(v).over(w).alias("_" + v) for v in values])
    at = F.explode(F.when(F.col("_t2").isNull(), F.array(time)).otherwise(F.sequence(F.col(time), F.col("_t2") - 1))).alias("_at")
    share = (F.col("_at") - F.col(time)) / F.coalesce(F.nullif(F.col("_t2") - F.col(time), F.lit(0)), F.lit(1))
    part = [F.coalesce(F.col(v) + (F.col("_" + v) - F.col(v)) * share, F.col(v)).alias(v) for v in values]
    return nxt.select("*", at).select(key, F.col("_at").alias(time), *part, (F.col("_at") != F.col(time)).alias("filled"))


#: Points of a track that one task smooths together, and points of the neighbouring pieces that it sees.
PIECE, OVERLAP = 96, 16


def in_pieces(tracks: DataFrame, values: tuple[str, ...], key: str = "obj", time: str = "t", piece: int = PIECE, before: int = OVERLAP, after: int = OVERLAP) -> DataFrame:
    """(obj, piece, t, values, i, n, core): the known points of each track in pieces of ``piece`` points, each with some of its neighbours' (core: false).

    So a long track is many groups. i is a point's number in its track, n their number.
    """
    known = tracks.select(F.col(key).alias("obj"), F.col(time).cast("int").alias("t"), *[F.col(v).cast("double").alias(v) for v in values])
    for c in ("obj", "t", *values):
        known = known.where(F.col(c).isNotNull())
    w = Window.partitionBy("obj")
    counted = known.withColumns({"i": (F.row_number().over(w.orderBy("t", *values)) - 1).cast("int"), "n": F.count(F.lit(1)).over(w).cast("int")})
    at = lambda shift: F.floor((F.col("i") + shift) / piece).cast("int")
    there = F.filter(F.sequence(at(-after), at(before)), lambda p: (p >= 0) & (p <= F.floor((F.col("n") - 1) / piece)))
    return counted.withColumn("piece", F.explode(there)).withColumn("core", F.col("piece") == at(0))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over a stated number of tasks: adaptive execution would join small ones, but splines take long for few bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def smooth_fill(tracks: DataFrame, s: float = 15.0, rescale: bool = False, k: int = 1, values: tuple[str, ...] = ("x", "y"), key: str = "obj", time: str = "t", piece: int = PIECE) -> DataFrame:
    """(obj, t, values): a smoothing spline through all known points of each track, read at every step between its first and last.

    The values are one parametric curve whose sum of squared errors is at most s. With ``rescale`` each value is a curve of its own, brought to the width of the
    times first and back after; one of no width is constant. Points of equal time count by their mean, those with a null not at all. A track of over
    ``piece`` points is smoothed in overlapping pieces, each with its share of s.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        later = rows[~rows["core"] & (rows["i"] > rows.loc[rows["core"], "i"].max())]
        core = rows[rows["core"]]
        at = np.arange(core["t"].iloc[0], later["t"].iloc[0] if len(later) else core["t"].iloc[-1] + 1)
        if (earlier := rows[~rows["core"] & (rows["i"] < core["i"].iloc[0])])["t"].eq(core["t"].iloc[0]).any() and len(earlier):
            at = at[1:]  # a time on the border belongs to the piece before
        t, y = distinct_times(rows["t"].to_numpy(float), rows[list(values)].to_numpy(float))
        share = s * len(rows) / rows["n"].iloc[0]
        if not rescale:
            out = smoothing_spline(t, y, share, k)(at)
        else:
            low, width, span = y.min(0), np.ptp(y, axis=0), max(np.ptp(t), 1)
            curves = [smoothing_spline(t, (c - a) * span / w, share, k)(at)[:, 0] / span * w + a if w > 0 else np.full(len(at), a) for c, a, w in zip(y.T, low, width, strict=True)]
            out = np.stack(curves, axis=1)
        return pd.DataFrame({"obj": rows["obj"].iloc[0], "t": at.astype("int32")} | dict(zip(values, out.T, strict=True)))

    pieces = in_pieces(tracks, values, key, time, piece)
    kind = pieces.schema["obj"].dataType.simpleString()
    return _dealt(pieces, "obj", "piece").groupBy("obj", "piece").applyInPandas(one, f"obj {kind}, t int, " + ", ".join(f"{v} double" for v in values))


def spline_at(tracks: DataFrame, times: DataFrame, s: float = 10.0, k: int = 1, last: int = 8, key: str = "obj", time: str = "t") -> DataFrame:
    """(obj, t, x, y): the spline of the ``last`` points of each track, read at each of its ``times`` (obj, t), within or beyond them.

    A track without known points is left out.
    """

    def one(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(asked):
            return pd.DataFrame({"obj": [], "t": [], "x": [], "y": []})
        t, y = distinct_times(known["t"].to_numpy(float), known[["x", "y"]].to_numpy(float))
        out = smoothing_spline(t, y, s, k)(asked["t"].to_numpy(float))
        return pd.DataFrame({"obj": asked["obj"], "t": asked["t"], "x": out[:, 0], "y": out[:, 1]})

    ends = Window.partitionBy(key).orderBy(F.desc(time))
    recent = tracks.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_n", F.row_number().over(ends)).where(F.col("_n") <= last)
    known = recent.select(F.col(key).alias("obj"), F.col(time).cast("int").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    asked = times.select(F.col("obj"), F.col("t").cast("int").alias("t"))
    kind = known.schema["obj"].dataType.simpleString()
    return known.groupBy("obj").cogroup(asked.groupBy("obj")).applyInPandas(one, f"obj {kind}, t int, x double, y double")


def predictions(tracks: DataFrame, grid: list[tuple[int, float]], buffer: int = 3, key: str = "obj", time: str = "t", piece: int = PIECE) -> DataFrame:
    """(obj, i, k, s, d): how far each point lies from its prediction by the spline of the ``buffer`` points before it, for each (degree, smoothing) of the grid.

    Windows are local, so a long track is split into pieces that see ``buffer`` points of the piece before.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        t, y, i, core = rows["t"].to_numpy(float), rows[["x", "y"]].to_numpy(float), rows["i"].to_numpy(), rows["core"].to_numpy()
        asked = np.flatnonzero(core & (np.arange(len(rows)) >= buffer))
        before = asked[:, None] + np.arange(-buffer, 0)
        closed = (np.diff(t[before], axis=1) > 0).all(1) if buffer == 3 else np.zeros(len(asked), bool)
        out = []
        for k, s in grid:
            d = np.zeros(len(asked))
            easy = closed if k == 1 else np.zeros(len(asked), bool)
            if easy.any():
                told = after_three(t[before[easy]], y[before[easy]], t[asked[easy]], s)
                d[easy] = np.hypot(*(told - y[asked[easy]]).T)
            for n in np.flatnonzero(~easy):
                at = asked[n]
                d[n] = np.hypot(*(smoothing_spline(*distinct_times(t[before[n]], y[before[n]]), s, k)(t[at : at + 1])[0] - y[at]))
            out.append(pd.DataFrame({"obj": rows["obj"].iloc[0], "i": i[asked], "k": k, "s": s, "d": d}))
        return pd.concat(out)

    pieces = in_pieces(tracks, ("x", "y"), key, time, piece, buffer, 0)
    kind = pieces.schema["obj"].dataType.simpleString()
    return _dealt(pieces, "obj", "piece").groupBy("obj", "piece").applyInPandas(one, f"obj {kind}, i int, k int, s double, d double")


def walk_forward_spline(tracks: DataFrame, grid: list[tuple[int, float]], buffer: int = 3, key: str = "obj", time: str = "t") -> DataFrame:
    """(obj, k, s, error): the mean of ``predictions`` for each (degree, smoothing), rounded to two places."""
    return predictions(tracks, [(k, float(s)) for k, s in grid], buffer, key, time).groupBy("obj", "k", "s").agg(F.round(F.avg("d"), 2).alias("error"))


KS, SS = (1, 2), (0.0, 1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 1000.0, 10000.0)


def order_choice(tracks: DataFrame, ks: tuple[int, ...] = KS, ss: tuple[float, ...] = SS, buffer_full: int = 8, buffer_few: int = 3, points_few: int = 5, points_full: int = 20, key: str = "obj", time: str = "t") -> DataFrame:
    """(obj, k, s, error, deltas): the first (degree, smoothing) of least mean error when a buffer is moved over the end of each track, and that choice's errors.

    Of a track of over ``points_full`` + ``buffer_full`` points the last ``points_full`` are predicted, each from ``buffer_full`` points; of a shorter one of over ``points_few`` +
    ``buffer_few`` the last ``points_few``, from as many as that leaves. Others take (1, 5), a null error, and halves of their last displacements.
    """
    grid = [(k, float(s)) for k in ks for s in ss]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, y, n = rows["t"].to_numpy(float), rows[["x", "y"]].to_numpy(float), rows["n"].iloc[0]
        buffer = buffer_full if n > points_full + buffer_full else n - points_few if n > points_few + buffer_few else 0
        if not buffer:
            steps = np.hypot(*np.diff(y, axis=0).T)[-buffer_full:] * 0.5
            return pd.DataFrame({"obj": rows["obj"].iloc[:1], "k": 1, "s": 5.0, "error": None, "deltas": [steps.tolist()]})
        errors = np.zeros((len(grid), len(t) - buffer))
        for i in range(errors.shape[1]):
            known = distinct_times(t[i : i + buffer], y[i : i + buffer])
            for g, (k, s) in enumerate(grid):
                errors[g, i] = np.hypot(*(smoothing_spline(*known, s, k)(t[i + buffer : i + buffer + 1])[0] - y[i + buffer]))
        mean = np.round(errors.mean(1), 2)
        best = int(mean.argmin())
        return pd.DataFrame({"obj": rows["obj"].iloc[:1], "k": grid[best][0], "s": grid[best][1], "error": mean[best], "deltas": [errors[best].tolist()]})

    w = Window.partitionBy(key)
    back = F.row_number().over(w.orderBy(F.desc(time), F.desc("x"), F.desc("y")))
    recent = tracks.where("x IS NOT NULL AND y IS NOT NULL").withColumns({"_back": back, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_back") <= points_full + buffer_full)
    known = recent.select(F.col(key).alias("obj"), F.col(time).cast("int").alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("_n").alias("n"))
    kind = known.schema["obj"].dataType.simpleString()
    return _dealt(known, "obj").groupBy("obj").applyInPandas(one, f"obj {kind}, k int, s double, error double, deltas array<double>")


def holdout_choice(tracks: DataFrame, ks: tuple[int, ...] = KS, ss: tuple[float, ...] = SS, share: float = 0.2, trials: int = 3, seed: int = 0, key: str = "obj", time: str = "t", piece: int = PIECE) -> DataFrame:
    """(obj, k, s, error): the first (degree, smoothing) of least mean error when a seeded ``share`` of the inner points is left out and read from the spline of the rest.

    The error is the mean over ``trials``, rounded to three places. As smoothings of one degree are tried in order until one gives the error of the one before,
    later ones do not count. Tracks of which nothing can be left out take (1, 5), with a null error.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        t, y = distinct_times(rows["t"].to_numpy(float), rows[["x", "y"]].to_numpy(float))
        drop, out = int(np.ceil(max(len(t) - 2, 0) * share)), []
        for trial in range(trials if drop else 0):
            gone = np.random.default_rng((seed, trial, int(rows["piece"].iloc[0]))).choice(np.arange(1, len(t) - 1), drop, replace=False)
            left = np.delete(np.arange(len(t)), gone)
            for k in ks:
                if len(left) > k:
                    for s in ss:
                        d = np.hypot(*(smoothing_spline(t[left], y[left], s, k)(t[gone]) - y[gone]).T)
                        out.append((trial, k, float(s), d.sum(), len(d)))
        return pd.DataFrame(out, columns=["trial", "k", "s", "d", "m"]).assign(obj=rows["obj"].iloc[0])[["obj", "trial", "k", "s", "d", "m"]]

    pieces = in_pieces(tracks, ("x", "y"), key, time, piece, 0, 0)
    kind = pieces.schema["obj"].dataType.simpleString()
    told = _dealt(pieces, "obj", "piece").groupBy("obj", "piece").applyInPandas(one, f"obj {kind}, trial int, k int, s double, d double, m long")
    each = told.groupBy("obj", "trial", "k", "s").agg((F.sum("d") / F.sum("m")).alias("d")).groupBy("obj", "k", "s").agg(F.round(F.avg("d"), 3).alias("error"))
    w = Window.partitionBy("obj", "k").orderBy("s")
    counted = each.withColumn("again", (F.lag("error").over(w) == F.col("error")).cast("int")).withColumn("stopped", F.coalesce(F.max("again").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    best = select_by_error(counted.where("stopped = 0").select("obj", "k", "s", "error"), "obj")
    everyone = tracks.where(f"{time} IS NOT NULL").select(F.col(key).alias("obj")).where("obj IS NOT NULL").distinct()
    return everyone.join(best, "obj", "left").select("obj", F.coalesce("k", F.lit(1)).alias("k"), F.coalesce("s", F.lit(5.0)).alias("s"), "error")


def walk_forward_error(tracks: DataFrame, grid: list[tuple[int, float]], key: str = "obj", time: str = "t") -> DataFrame:
    """(obj, k, s, error): mean distance of one-step predictions from the positions that came, for each (order, smoothing) of the grid.

    Order 0 repeats the last position; order 1 extrapolates three. Errors are rounded to two places.
    """
    w = _by(key, time)
    parts = []
    for k, s in grid:
        told = extrapolate3(tracks, key, time, s) if k else tracks.withColumns({"x_next": F.col("x"), "y_next": F.col("y")})
        seen = told.withColumns({"px": F.lag("x_next").over(w), "py": F.lag("y_next").over(w), "_n": F.row_number().over(w)}).where("px IS NOT NULL AND _n > 3")
        d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
        parts.append(seen.groupBy(key).agg(F.round(F.avg(d), 2).alias("error")).select(key, F.lit(k).alias("k"), F.lit(float(s)).alias("s"), "error"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_by_error(errors: DataFrame, key: str = "obj") -> DataFrame:
    """The first (k, s) of least error for each object."""
    return errors.groupBy(key).agg(F.min(F.struct("error", "k", "s")).alias("b")).select(key, "b.k", "b.s", "b.error")


def holdout_error(tracks: DataFrame, share: int = 5, key: str = "obj", time: str = "t") -> DataFrame:
    """(obj, error): mean distance of every ``share``-th inner point from the line between its neighbours; a seeded choice by time."""
    w = _by(key, time)
    around = tracks.withColumns({f"{c}{n}": f(c).over(w) for c in ("x", "y", time) for n, f in (("_a", F.lag), ("_b", F.lead))}).where(f"{time}_a IS NOT NULL AND {time}_b IS NOT NULL AND {time} % {share} = 0")
    part = (F.col(time) - F.col(f"{time}_a")) / (F.col(f"{time}_b") - F.col(f"{time}_a"))
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}_a") - (F.col(f"{c}_b") - F.col(f"{c}_a")) * part) ** 2 for c in "xy"), F.lit(0.0)))
    return around.groupBy(key).agg(F.round(F.avg(d), 4).alias("error"))


def history_rule(n: Column, buffer_full: int = 8, buffer_few: int = 3, points_few: int = 5, points_full: int = 20) -> dict[str, Column]:
    """Buffer length and start by the number of known points."""
    size = F.when(n >= points_full, buffer_full).when(n > points_few, F.least(F.lit(buffer_full), F.greatest(F.lit(buffer_few), n - points_few))).otherwise(buffer_few)
    return {"buffer": size.cast("int"), "search": n > buffer_full + points_few}


def ring_buffer(df: DataFrame, value: str, size: int, key: str = "obj", time: str = "t", reverse: bool = False) -> DataFrame:
    """ring: the last ``size`` values, oldest first; reversed, the next ones, as a buffer filled from the far end."""
    w = _by(key, time).rowsBetween(0, size - 1) if reverse else _by(key, time).rowsBetween(1 - size, 0)
    return df.withColumn("ring", F.collect_list(value).over(w))


def changed(old: DataFrame, new: DataFrame, key: str = "seg", count: str = "n") -> DataFrame:
    """The keys of ``new`` that are not in ``old`` or have another count there."""
    met = new.join(old.select(key, F.col(count).alias("_n")), key, "left")
    return met.where(F.col("_n").isNull() | (F.col("_n") != F.col(count))).drop("_n")


def gaussian_average(df: DataFrame, value: str, radius: int = 2, sigma: float = 1.0, key: str = "obj", time: str = "t") -> DataFrame:
    """smooth: the mean of the values within ``radius`` steps, by Gaussian weights of the difference in time."""
    w = _by(key, time)
    num, den = F.lit(0.0), F.lit(0.0)
    for k in range(-radius, radius + 1):
        v, dt = F.lag(value, k).over(w), F.col(time) - F.lag(time, k).over(w)
        weight = F.when(v.isNotNull() & (F.abs(dt) <= radius), F.exp(-0.5 * (dt / sigma) ** 2)).otherwise(0.0)
        num, den = num + weight * F.coalesce(v, F.lit(0.0)), den + weight
    return df.withColumn("smooth", num / den)


def decaying_gate(n: Column, mean: Column, std: Column, amplitude: float = 20, rate: float = 0.5, cutoff: int = 6, sigmas: float = 3) -> Column:
    """The distance allowed: mean and ``sigmas`` deviations, and at first an amplitude that decays with the steps seen."""
    return mean + sigmas * std + F.when(n <= cutoff, amplitude * F.exp(-rate * (n - 1))).otherwise(0.0)


def damped_extrapolation(tracks: DataFrame, most_angle: float = 90.0, key: str = "obj", time: str = "t") -> DataFrame:
    """x_next, y_next: the last position plus the last step, halved where the path turns by over ``most_angle`` degrees."""
    w = _by(key, time)
    d = {c: (F.col(c) - F.lag(c).over(w), F.lag(c).over(w) - F.lag(c, 2).over(w)) for c in "xy"}
    out = tracks.withColumns({f"_{c}{i}": d[c][i] for c in "xy" for i in (0, 1)})
    norm = F.sqrt((F.col("_x0") ** 2 + F.col("_y0") ** 2) * (F.col("_x1") ** 2 + F.col("_y1") ** 2))
    cos = (F.col("_x0") * F.col("_x1") + F.col("_y0") * F.col("_y1")) / F.nullif(norm, F.lit(0.0))
    damp = F.when(cos < math.cos(math.radians(most_angle)), 0.5).otherwise(1.0)
    return out.withColumns({f"{c}_next": F.col(c) + F.col(f"_{c}0") * damp for c in "xy"}).drop("_x0", "_x1", "_y0", "_y1")


def frozen_recent(tracks: DataFrame, entries: int = 5, age: int = 50, most: float = 5.0, key: str = "obj", time: str = "t") -> DataFrame:
    """still: whether the mean distance of up to ``entries`` last positions, none older than ``age``, from the oldest of them is under ``most``."""
    w = _by(key, time).rowsBetween(1 - entries, 0)
    recent = F.filter(F.collect_list(F.struct(F.col(time).alias("t"), "x", "y")).over(w), lambda p: p["t"] >= F.col(time) - age)
    out = tracks.withColumn("_r", recent)
    far = F.aggregate("_r", F.lit(0.0), lambda a, p: a + F.sqrt((p["x"] - F.col("_r")[0]["x"]) ** 2 + (p["y"] - F.col("_r")[0]["y"]) ** 2)) / F.size("_r")
    return out.withColumn("still", (F.size("_r") == entries) & (far < most)).drop("_r")


def split_persistence(pairs: DataFrame, growth: float = 5.0, apart: float = 15.0, key: str = "obj", time: str = "t") -> DataFrame:
    """confirmed: the distance d grew in the last two steps and by ``growth`` in all, or was at least ``apart`` in all three."""
    w = _by(key, time)
    a, b, c = F.lag("d", 2).over(w), F.lag("d").over(w), F.col("d")
    return pairs.withColumn("confirmed", F.coalesce(((a < b) & (b < c) & (c - a >= growth)) | (F.least(a, b, c) >= apart) & a.isNotNull(), F.lit(False)))


def split_merge_pairs(splits: DataFrame, merges: DataFrame, gap: int = 8, key: str = "obj", most_distance: float | None = None) -> DataFrame:
    """Each split (t, x, y) with the first merge after it within ``gap`` steps: (t_split, t_merge, d).

    One union and one window by object: no range join.
    """
    both = splits.select(key, "t", F.lit(0).alias("_m"), F.struct("t", "x", "y").alias("p")).unionByName(merges.select(key, "t", F.lit(1).alias("_m"), F.struct("t", "x", "y").alias("p")))
    ahead = Window.partitionBy(key).orderBy("t", F.desc("_m")).rowsBetween(1, Window.unboundedFollowing)
    met = both.withColumn("q", F.first(F.when(F.col("_m") == 1, F.col("p")), True).over(ahead)).where(F.expr(f"_m = 0 AND q.t - p.t > 0 AND q.t - p.t < {gap}"))
    out = met.select(key, F.col("p.t").alias("t_split"), F.col("q.t").alias("t_merge"), F.sqrt((F.col("p.x") - F.col("q.x")) ** 2 + (F.col("p.y") - F.col("q.y")) ** 2).alias("d"))
    return out if most_distance is None else out.where(F.col("d") < most_distance)


def average_speed(tracks: DataFrame, least: float, key: str = "obj", time: str = "t") -> DataFrame:
    """Tracks of two points or more whose way from first to last position, by number of points, is over ``least``."""
    g = tracks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y"), time).alias("a"), F.max_by(F.struct("x", "y"), time).alias("b"))
    speed = F.sqrt((F.col("b.x") - F.col("a.x")) ** 2 + (F.col("b.y") - F.col("a.y")) ** 2) / F.col("n")
    return g.where("n >= 2").withColumn("speed", speed).where(F.col("speed") > least).select(key, "n", "speed")
