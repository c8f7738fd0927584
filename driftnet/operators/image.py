"""Frames as rows: pixel arithmetic in SQL, neighbourhood operators in NumPy by frame."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME = "frame_id int, h int, w int, px binary"
CONTOUR = "t int, id int, parent_id int, pts array<struct<x:int,y:int>>, bx int, by int, bw int, bh int, area long"

# Pixels as rows (t, pixel, v)


def pixel_mean(frames: DataFrame) -> DataFrame:
    return frames.groupBy("pixel").agg(F.round(F.avg("v"), 6).alias("mean"))


def slice_means(frames: DataFrame, width: int) -> DataFrame:
    """(slice, pixel, mean, weight): partial means of slices of ``width`` frames."""
    return frames.groupBy(F.floor(F.col("t") / width).cast("int").alias("slice"), "pixel").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("weight"))


def final_mean(parts: DataFrame) -> DataFrame:
    return parts.groupBy("pixel").agg(F.round(F.sum(F.col("mean") * F.col("weight")) / F.sum("weight"), 6).alias("mean"))


def mean_windows(frames: DataFrame, n: int) -> DataFrame:
    """(switch, start, stop): windows of n frames that overlap by half; each begins a quarter before its switch, the last ends with the frames."""
    ends = frames.agg(F.max("t").alias("m"))
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("m") - n // 4) / (n // 2)).cast("int"))))
    w = ends.select("m", k.alias("k")).select("m", F.when(F.col("k") == 0, 0).otherwise(n // 4 + (F.col("k") - 1) * (n // 2) + n // 2).alias("switch"))
    w = w.select("m", "switch", F.when(F.col("switch") == 0, 0).otherwise(F.col("switch") - n // 4).alias("start"))
    last = F.max("switch").over(_whole())
    return w.select("switch", "start", F.when(F.col("switch") == last, F.col("m") + 1).otherwise(F.least(F.col("start") + n, F.col("m") + 1)).cast("int").alias("stop"))


def _whole():
    from pyspark.sql.window import Window

    return Window.partitionBy(F.lit(0))  # a window table has a row for each n / 2 frames


def window_means(frames: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(switch, pixel, mean): each frame meets its windows by buckets of n frames."""
    bucketed = windows.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / n), F.floor((F.col("stop") - 1) / n))))
    met = frames.withColumn("k", F.floor(F.col("t") / n)).join(bucketed, "k").where("t >= start AND t < stop")
    return met.groupBy("switch", "pixel").agg(F.round(F.avg("v"), 6).alias("mean"))


def subtract(frames: DataFrame, mean: DataFrame) -> DataFrame:
    """d: the signed difference of each pixel from its mean."""
    return frames.join(mean, "pixel").withColumn("d", F.col("v") - F.col("mean"))


def binarize(value: Column, threshold: float = 10) -> Column:
    return F.when(value < threshold, 0).otherwise(255)


def keep_inside(df: DataFrame, width: int, height: int, top: int = 80, bottom: int = 80, left: int = 100, right: int = 100, least: int = 180) -> DataFrame:
    """Boxes (x, y, w, h) with area of ``least`` or more that reach within all four borders."""
    drop = f"w * h < {least} OR y + h < {top} OR y > {height - bottom} OR x + w < {left} OR x > {width - right}"
    return df.where(f"NOT ({drop})")


def slices(length: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(a + width, length)) for a in range(0, length, width)]


def round_robin(df: DataFrame, value: str, bins: int) -> DataFrame:
    return df.withColumn("bin", F.pmod(F.col(value), F.lit(bins)).cast("int"))


def brightness(mean: Column) -> Column:
    return F.least(mean / 255 / 0.66, F.lit(1.0))


def red(r: Column, g: Column, b: Column) -> Column:
    """Whether a pixel is strong red: hue within 20 degrees of red, saturation and value of 50 of 255 at least."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = (top - low).cast("double")
    hue = F.when(top == r, F.abs(F.try_divide(F.lit(60) * (g - b), spread)))
    return F.coalesce((hue <= 20) & (top >= 50) & (spread / top * 255 >= 50), F.lit(False))


def rotate(x: Column, y: Column, w: int, h: int, quarter: int) -> tuple[Column, Column]:
    """A pixel's place after ``quarter`` turns counter-clockwise of a picture w by h."""
    return [(x, y), (y, F.lit(w - 1) - x), (F.lit(w - 1) - x, F.lit(h - 1) - y), (F.lit(h - 1) - y, x)][quarter % 4]


# Frames as binary rows


def decode_bmp(data: bytes) -> np.ndarray:
    """The grey values of an uncompressed 8- or 24-bit BMP."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    offset, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed BMP of 8 or 24 bits")
    row = (w * bits // 8 + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, row * abs(h), offset).reshape(abs(h), row)[:, : w * bits // 8]
    if h > 0:
        px = px[::-1]
    if bits == 24:
        b, g, r = (px.reshape(abs(h), w, 3)[..., i].astype(float) for i in range(3))
        return np.round(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)
    table = np.frombuffer(data, np.uint8, 1024, 14 + size).reshape(256, 4)[:, :3].astype(float)
    return np.round(table @ [0.114, 0.587, 0.299]).astype(np.uint8)[px]


def encode_bmp(image: np.ndarray) -> bytes:
    h, w = image.shape
    row = (w + 3) // 4 * 4
    px = np.zeros((h, row), np.uint8)
    px[:, :w] = image[::-1]
    table = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    table[:, 3] = 0
    return b"BM" + struct.pack("<IHHI", 1078 + px.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, px.size, 0, 0, 256, 0) + table.tobytes() + px.tobytes()


def per_frame(frames: DataFrame, step, schema: str = FRAME) -> DataFrame:
    """Frames (frame_id, h, w, px) through ``step``, which takes an image and returns one of any size."""

    def run(batches):
        for b in batches:
            done = [step(np.frombuffer(p, np.uint8).reshape(h, w)) for p, h, w in zip(b["px"], b["h"], b["w"], strict=True)]
            yield pd.DataFrame({"frame_id": b["frame_id"], "h": [x.shape[0] for x in done], "w": [x.shape[1] for x in done], "px": [np.ascontiguousarray(x, np.uint8).tobytes() for x in done]})

    return frames.select("frame_id", "h", "w", "px").mapInPandas(run, schema)


def _neighbourhood(image: np.ndarray, kernel: np.ndarray, pick, fill: int) -> np.ndarray:
    kh, kw = kernel.shape
    top, left = (kh - 1) // 2, (kw - 1) // 2
    padded = np.pad(image, ((top, kh - 1 - top), (left, kw - 1 - left)), constant_values=fill)
    out = None
    for i, j in zip(*np.nonzero(kernel), strict=True):
        part = padded[i : i + image.shape[0], j : j + image.shape[1]]
        out = part.copy() if out is None else pick(out, part)
    return out


def dilate(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return _neighbourhood(image, kernel[::-1, ::-1], np.maximum, 0)


def erode(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return _neighbourhood(image, kernel, np.minimum, 255)


def opening(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return dilate(erode(image, kernel), kernel)


def disc(size: int) -> np.ndarray:
    """An elliptical kernel of odd size."""
    r = size // 2
    y = np.arange(-r, r + 1)
    half = np.round(r * np.sqrt(np.maximum(0, 1 - (y / max(r, 1)) ** 2))).astype(int)
    return (np.abs(np.arange(-r, r + 1))[None, :] <= half[:, None]).astype(np.uint8)


def box_blur(image: np.ndarray, size: int = 5, mode: str = "symmetric") -> np.ndarray:
    """Mean of a square neighbourhood; ``mode`` mirrors the border with (symmetric) or without (reflect) its own pixels."""
    r = size // 2
    p = np.pad(image.astype(float), r, mode=mode)
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / size**2


def undistort(image: np.ndarray, map_x: np.ndarray, map_y: np.ndarray) -> np.ndarray:
    """Bilinear reading of the image at the mapped places; zero outside."""
    p = np.pad(image.astype(float), 1)
    x, y = np.clip(map_x + 1, 0, p.shape[1] - 1.001), np.clip(map_y + 1, 0, p.shape[0] - 1.001)
    i, j = y.astype(int), x.astype(int)
    a, b = y - i, x - j
    v = p[i, j] * (1 - a) * (1 - b) + p[i, j + 1] * (1 - a) * b + p[i + 1, j] * a * (1 - b) + p[i + 1, j + 1] * a * b
    return np.round(v).astype(np.uint8)


def binary_pipe(image: np.ndarray, mean: np.ndarray, threshold: int = 10) -> np.ndarray:
    mask = np.where(np.clip(image.astype(float) - mean, 0, 255) >= threshold, 255, 0).astype(np.uint8)
    return erode(dilate(opening(mask, np.ones((5, 5))), np.ones((8, 8))), np.ones((5, 5)))


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Component numbers from 1 by least-label passes along rows' runs."""
    h, w = mask.shape
    parent = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros((h, w), np.int32)
    before: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.r_[0, mask[y] > 0, 0]))
        now = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            mine = 0
            for c, d, k in before:
                if c < b + diagonal and a < d + diagonal:
                    k = find(k)
                    if mine and k != mine:
                        parent[max(k, mine)] = min(k, mine)
                        mine = min(k, mine)
                    else:
                        mine = k
            if not mine:
                mine = len(parent)
                parent.append(mine)
            out[y, a:b] = mine
            now.append((a, b, mine))
        before = now
    roots = np.array([find(i) if i else 0 for i in range(len(parent))])
    _, number = np.unique(roots, return_inverse=True)
    return number[out].astype(np.int32)


def clear_border(mask: np.ndarray, width: int = 5) -> np.ndarray:
    """The mask without the components that touch a border of ``width``."""
    wide = mask.copy()
    wide[:width], wide[-width:], wide[:, :width], wide[:, -width:] = 255, 255, 255, 255
    number = label(wide)
    return np.where(number == number[0, 0], 0, mask).astype(np.uint8)


def components(mask: np.ndarray) -> list[dict]:
    """Outer and inner borders of the mask's components: their border pixels, box, pixels and parent.

    Components and the holes between them alternate; a hole's parent is the component around it, a component's parent the hole it lies in.
    """
    solid, empty = label(mask), label(np.pad(mask == 0, 1, constant_values=True).astype(np.uint8), False)
    outside = empty[0, 0]
    empty = empty[1:-1, 1:-1]
    parts = []
    for kind, number in (("solid", solid), ("hole", empty)):
        for k in range(1, int(number.max(initial=0)) + 1):
            if kind == "hole" and k == outside:
                continue
            own = number == k
            if own.any():
                y, x = np.nonzero(own)
                parts.append((int(y[0]), int(x[0]), kind, k, own, y, x))
    parts.sort(key=lambda p: p[:2])
    at = {(p[2], p[3]): i for i, p in enumerate(parts)}
    out = []
    for i, (y0, x0, kind, _, own, y, x) in enumerate(parts):
        other = (empty if kind == "solid" else solid)[y0 - 1, x0] if y0 else outside
        parent = at.get(("hole" if kind == "solid" else "solid", int(other)))
        inner = own & ~(_neighbourhood(own.astype(np.uint8), np.ones((3, 3)), np.minimum, 0) > 0)
        by, bx = np.nonzero(inner)
        out.append({"id": i, "parent_id": parent, "pts": [{"x": int(a), "y": int(b)} for a, b in zip(bx, by, strict=True)], "bx": int(x.min()), "by": int(y.min()), "bw": int(np.ptp(x)) + 1, "bh": int(np.ptp(y)) + 1, "area": int(own.sum())})
    return out


def contours(frames: DataFrame) -> DataFrame:
    """A row for each component and hole of each mask: border points, box, pixels, and the row that encloses it."""

    def run(batches):
        for b in batches:
            rows = [{"t": t, **c} for t, p, h, w in zip(b["frame_id"], b["px"], b["h"], b["w"], strict=True) for c in components(np.frombuffer(p, np.uint8).reshape(h, w))]
            if rows:
                yield pd.DataFrame(rows).astype({"parent_id": "Int32"})

    return frames.select("frame_id", "h", "w", "px").mapInPandas(run, CONTOUR)


def match_template(image: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """(x, y) of the least sum of squared differences."""
    view = np.lib.stride_tricks.sliding_window_view(image.astype(float), part.shape)
    d = ((view - part) ** 2).sum((2, 3))
    y, x = np.unravel_index(int(d.argmin()), d.shape)
    return int(x), int(y)


def otsu(image: np.ndarray) -> int:
    """The threshold that parts the grey values best."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    w, m = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def fullness(mask: np.ndarray, steps: int = 5) -> float:
    """Slope of the area that is left after each erosion against the steps: steeper for partial, ring-like shapes."""
    areas, now = [], mask
    for _ in range(steps + 1):
        areas.append(int((now > 0).sum()))
        now = erode(now, np.ones((3, 3)))
    share = np.array(areas) / max(areas[0], 1)
    return float(np.polyfit(np.arange(steps + 1), share, 1)[0])


def gray_to_rgb(image: np.ndarray) -> np.ndarray:
    """Three equal channels of a grey image; a colour image as it is."""
    return np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image


def mask_hits(contours: DataFrame, mask: DataFrame) -> DataFrame:
    """The contours (t, id, pts) with a vertex on a pixel of a mask (x, y)."""
    vertices = contours.select("t", "id", F.explode("pts").alias("p")).select("t", "id", F.col("p.x").cast("int").alias("x"), F.col("p.y").cast("int").alias("y"))
    return vertices.join(mask.select("x", "y").distinct(), ["x", "y"], "left_semi").select("t", "id").distinct()


def annotate(frames: DataFrame, boxes: DataFrame, value: int = 255) -> DataFrame:
    """Frames with the outlines of their boxes (t, x, y, w, h) drawn in."""

    def draw(f: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, h, w, px in zip(f["frame_id"], f["h"], f["w"], f["px"], strict=True):
            image = np.frombuffer(px, np.uint8).reshape(h, w).copy()
            for x, y, bw, bh in zip(b["x"], b["y"], b["w"], b["h"], strict=True):
                image[max(y, 0) : y + bh, max(x, 0) : x + bw][[0, -1]] = value
                image[max(y, 0) : y + bh, max(x, 0) : x + bw][:, [0, -1]] = value
            out.append((i, h, w, image.tobytes()))
        return pd.DataFrame(out, columns=["frame_id", "h", "w", "px"])

    inside = boxes.select(F.col("t").cast("int").alias("frame_id"), "x", "y", "w", "h").join(frames.select("frame_id", F.col("h").alias("fh"), F.col("w").alias("fw")), "frame_id").where("x < fw AND y < fh AND x + w > 0 AND y + h > 0 AND w > 0 AND h > 0")
    return frames.select("frame_id", "h", "w", "px").groupBy("frame_id").cogroup(inside.groupBy("frame_id")).applyInPandas(draw, FRAME)
