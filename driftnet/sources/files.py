"""Sources and sinks: frame files, stage artifacts, tables and graphs."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftnet.operators.image import FRAME, decode_bmp, undistort


def frame_number(path: str | Column) -> Column:
    """The first whole number in a file's name; null without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")), F.lit("999999999999")).cast("bigint")


def list_frames(spark: SparkSession, folder: str, suffix: str, start: int, stop: int) -> DataFrame:
    """(frame_id, path): the files of a folder tree whose number is in [start, stop), the greatest path where a number comes twice."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.withColumn("frame_id", frame_number("path")).where(F.col("frame_id").between(start, stop - 1)).groupBy("frame_id").agg(F.max("path").alias("path"))


def missing_frames(frames: DataFrame, start: int, stop: int, key: str = "frame_id") -> DataFrame:
    """The numbers of [start, stop) that no frame has."""
    return frames.sparkSession.range(start, stop).join(frames.select(F.col(key).alias("id")).distinct(), "id", "left_anti")


def range_name(start: Column, stop: Column) -> Column:
    """The name of a range's folder, both ends filled up to five digits."""
    filled = lambda c: F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(5)), F.lit("0"))
    return F.concat_ws("-", filled(start), filled(stop))


def read_frames(spark: SparkSession, folder: str, suffix: str = ".bmp", map_x: np.ndarray | None = None, map_y: np.ndarray | None = None) -> DataFrame:
    """Grey frames (frame_id, h, w, px), undistorted by the calibration maps if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)

    def run(batches):
        for b in batches:
            done = [decode_bmp(c) for c in b["content"]]
            if map_x is not None:
                done = [undistort(x, map_x, map_y) for x in done]
            yield pd.DataFrame({"frame_id": b["frame_id"], "h": [x.shape[0] for x in done], "w": [x.shape[1] for x in done], "px": [x.tobytes() for x in done]})

    return files.select(frame_number("path").cast("int").alias("frame_id"), "content").mapInPandas(run, FRAME)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], compression: str = "zstd") -> DataFrame:
    """The table at ``path``, made and written first if it is not there yet; what an interrupted write left there is replaced."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def artifact_catalog(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """(flow, artifacts): for each flow (characters 4 to 6 of the folder's name) the path of each prefix's file, from (path)."""
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    prefix = F.coalesce(*[F.when(F.startswith(name, F.lit(p)), F.lit(p)) for p in prefixes])
    rows = files.select(F.expr("try_cast(substring(element_at(split(path, '/'), -2), 4, 3) AS int)").alias("flow"), prefix.alias("prefix"), "path", folder.alias("folder")).where("prefix IS NOT NULL AND flow IS NOT NULL")
    return rows.groupBy("flow", "prefix").agg(F.max("path").alias("path")).groupBy("flow").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prefix", "path")))).alias("artifacts"))


def write_detections(detections: DataFrame, path: str) -> None:
    """Appends (frame, local_id, x, y, area) as CSV."""
    detections.select("frame", "local_id", "x", "y", "area").write.mode("append").csv(path)


def write_tracks(tracks: DataFrame, ids: list, path: str, pixels_per_cm: float) -> None:
    """A wide CSV: a row for each t, x and y columns for each track, in centimetres."""
    wide = tracks.select("t", "obj", (F.col("x") / pixels_per_cm).alias("cx"), (F.col("y") / pixels_per_cm).alias("cy"))
    wide.groupBy("t").pivot("obj", ids).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy")).orderBy("t").write.mode("overwrite").option("header", "true").csv(path)


def without_images(archive: DataFrame, columns: tuple[str, ...] = ("px", "mask")) -> DataFrame:
    return archive.drop(*columns)


def graph_xml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(family, xml): each family of nodes (family, node, label) and edges (family, src, dst) as a GEXF document; written in rows, so families
    are written in parallel."""

    def of(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if n.empty:
            return pd.DataFrame({"family": [], "xml": []})
        body = "".join(f"<node id={quoteattr(str(i))} label={quoteattr(str(x))}/>" for i, x in zip(n.sort_values("node")["node"], n.sort_values("node")["label"], strict=True))
        links = "".join(f'<edge id="{k}" source={quoteattr(str(a))} target={quoteattr(str(b))}/>' for k, (a, b) in enumerate(sorted(zip(e["src"], e["dst"], strict=True))))
        xml = f'<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>{body}</nodes><edges>{links}</edges></graph></gexf>'
        return pd.DataFrame({"family": [n["family"].iloc[0]], "xml": [xml]})

    return nodes.groupBy("family").cogroup(edges.groupBy("family")).applyInPandas(of, "family long, xml string")
