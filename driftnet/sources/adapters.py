"""The driver's tables read as detections, tracks, segments and frames.

Numbering is by key (an order, a user), never over a whole table, so every adapter is one shuffle on that key at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Frames are weeks from this day; steps are hours from the other.
FIRST_DAY, FIRST_HOUR, DAYS = "1995-01-01", "2024-01-01", 7
WIDTH, HEIGHT = 1200, 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, days: int = DAYS) -> DataFrame:
    """(t, id, x, y, w, h): line items as boxes, a frame for each ``days`` days."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rank = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    numbered = item.select(
        "l_partkey",
        (F.col("l_orderkey") * 1000 + F.row_number().over(rank)).alias("id"),
        F.expr(f"CAST(datediff(l_shipdate, DATE '{FIRST_DAY}') DIV {days} AS INT)").alias("t"),
        F.expr(f"CAST((l_partkey * 37 + l_orderkey * 11) % {WIDTH} AS INT)").alias("x"),
        F.expr(f"CAST((l_suppkey * 53 + l_orderkey) % {HEIGHT} AS INT)").alias("y"),
        F.col("l_quantity").cast("int").alias("w"),
    )
    return numbered.join(part, numbered["l_partkey"] == part["p_partkey"]).select("t", "id", "x", "y", "w", F.col("p_size").alias("h"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj, t, step, x, y, area, kind): a user's events as the positions of an object."""
    event = table(spark, sf_dir, "events")
    return event.select(
        F.col("user_id").alias("obj"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("t"),
        F.expr(f"CAST(datediff(ts, DATE '{FIRST_HOUR}') * 24 + hour(ts) AS INT)").alias("step"),
        F.col("value").alias("x"),
        F.expr("CAST((event_id * 7919) % 1000 AS DOUBLE) / 4").alias("y"),
        F.expr("CAST(50 + (event_id * 31) % 500 AS BIGINT)").alias("area"),
        F.col("event_type").alias("kind"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obj, step, x, y, area): one position for each object and hour, of its first event there."""
    first = F.min_by(F.struct("x", "y", "area"), "t")
    return tracks(spark, sf_dir).groupBy("obj", "step").agg(first.alias("p")).select("obj", "step", "p.x", "p.y", "p.area")


def numbered_steps(spark: SparkSession, sf_dir: str, gap: int = 6) -> DataFrame:
    """(obj, step, x, y, area, seg): the steps with the number of the segment that each belongs to, from 1 on: a run without a gap of over ``gap``."""
    w = Window.partitionBy("obj").orderBy("step")
    cut = steps(spark, sf_dir).withColumn("new", F.coalesce((F.col("step") - F.lag("step").over(w) > gap).cast("int"), F.lit(1)))
    return cut.withColumn("seg", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def segments(spark: SparkSession, sf_dir: str, gap: int = 6) -> DataFrame:
    """(obj, seg, t_start, t_end, n, x_start, x_end, y_start, y_end): runs of an object's steps without a gap of over ``gap``."""
    return segments_of(numbered_steps(spark, sf_dir, gap))


def segments_of(numbered: DataFrame) -> DataFrame:
    """The ``segments`` of ``numbered_steps``."""
    return numbered.groupBy("obj", "seg").agg(
        F.min("step").alias("t_start"),
        F.max("step").alias("t_end"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("x", "step").alias("x_start"),
        F.max_by("x", "step").alias("x_end"),
        F.min_by("y", "step").alias("y_start"),
        F.max_by("y", "step").alias("y_end"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, pixel, v): embeddings as frames, positions as pixels, values from 0 to 255."""
    emb = table(spark, sf_dir, "embeddings")
    v = F.round(F.col("e").cast("double") * 200 + 100).cast("int")
    return emb.select(F.col("vec_id").cast("int").alias("t"), F.posexplode("embedding").alias("pixel", "e")).select("t", "pixel", F.least(F.greatest(v, F.lit(0)), F.lit(255)).alias("v"))
