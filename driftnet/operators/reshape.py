"""Aggregations, reshaping and set operations on composite nodes (t, ids) and tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def disperse(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(t, ids): all ids of the composite nodes (t, ids) of a time, sorted, repeats kept."""
    return nodes.select(*keys, "t", F.explode("ids").alias("id")).groupBy(*keys, "t").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def solo_nodes(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(t, id): the distinct single nodes within composite nodes (t, ids)."""
    return nodes.select(*keys, "t", F.explode("ids").alias("id")).distinct()


def unique_sorted(ids: str | Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def representatives(nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(t, ids): the smallest id of each composite node, by time."""
    return nodes.groupBy(*keys, "t").agg(F.array_sort(F.collect_set(F.array_min("ids"))).alias("ids"))


def contested(owned: DataFrame) -> DataFrame:
    """(t, id, owners): nodes (t, id, owner) with more than one owner."""
    return owned.groupBy("t", "id").agg(F.array_sort(F.collect_set("owner")).alias("owners")).where(F.size("owners") > 1)


def redistributions(contest: DataFrame, most: int = 100_000) -> DataFrame:
    """(variant, t, id, owner): every way to give each contested node (t, id, owners) to one of its owners.

    A variant's digits in the mixed base of the numbers of owners choose; the product must not pass ``most``.
    """
    sizes = contest.select("t", "id", "owners", F.size("owners").cast("long").alias("n")).orderBy("t", "id").collect()  # bounded: the product of sizes is checked
    total = 1
    for r in sizes:
        total *= r.n
        if total > most:
            raise ValueError(f"over {most} redistributions")
    bases, base = {}, 1
    for r in sizes:
        bases[r.t, r.id] = base
        base *= r.n
    spark = contest.sparkSession
    if not sizes:
        return spark.range(1).select(F.col("id").alias("variant"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("owner")).limit(0)
    rows = spark.createDataFrame([(r.t, r.id, b, r.owners) for r, b in zip(sizes, bases.values(), strict=True)], "t long, id long, base long, owners array<long>")
    variants = spark.range(total).withColumnRenamed("id", "variant")
    pick = F.element_at("owners", (F.floor(F.col("variant") / F.col("base")) % F.size("owners") + 1).cast("int"))
    return variants.join(F.broadcast(rows)).select("variant", "t", "id", pick.alias("owner"))


def valid_redistributions(variants: DataFrame, owned: DataFrame) -> DataFrame:
    """The variants that leave no owner without a node at a time where it had some (t, id, owner)."""
    contest = variants.select("t", "id").distinct()
    fixed = owned.join(contest, ["t", "id"], "left_anti").select("owner", "t").distinct()
    needed = owned.select("owner", "t").distinct().join(fixed, ["owner", "t"], "left_anti")
    all_needed = variants.select("variant").distinct().join(F.broadcast(needed))
    bad = all_needed.join(variants.select("variant", "owner", "t"), ["variant", "owner", "t"], "left_anti").select("variant").distinct()
    return variants.join(bad, "variant", "left_anti")


def weighted_centroid(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Centroid of points (x, y, area), the areas as weights."""
    mean = lambda c: (F.sum(F.col(c) * F.col("area")) / F.sum("area")).alias(c)
    return points.groupBy(*keys).agg(mean("x"), mean("y"), F.sum("area").alias("area"))


def running_stats(df: DataFrame, value: str, key: str = "obj", time: str = "t") -> DataFrame:
    """Mean and population deviation of all values so far."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w), "n": F.count(value).over(w)})


def floored_stats(df: DataFrame, value: str, key: str = "obj", time: str = "t", history: int = 2) -> DataFrame:
    """Mean and deviation of the last ``history`` and the present value; the deviation is at least 10 % of the mean, 15 % with one value
    before, 20 % with none."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(-history, 0)
    n = F.count(value).over(w)
    floor = F.when(n == 1, 0.2).when(n == 2, 0.15).otherwise(0.1) * F.avg(value).over(w)
    return df.withColumns({"mean": F.avg(value).over(w), "std": F.greatest(F.stddev_pop(value).over(w), floor)})


def event_box(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, t, x, y, w, h): the box around an event's boxes (t, x, y, w, h), at every time from its first to its last."""
    whole = parts.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.expr("x + w")).alias("x2"), F.max(F.expr("y + h")).alias("y2"))
    return whole.select(*keys, F.explode(F.sequence("a", "b")).alias("t"), "x", "y", F.expr("x2 - x AS w"), F.expr("y2 - y AS h"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal bins from the least to the greatest value."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).select(F.coalesce(place, F.lit(0)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def best_of_duplicates(df: DataFrame, key: str, a: str, b: str, tie: str) -> DataFrame:
    """For each key the row of least mean of ``a`` and ``b``, each divided by its greatest value for the key."""
    w = Window.partitionBy(key)
    scaled = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0)), F.lit(0.0))
    scored = df.withColumn("score", F.round((scaled(a) + scaled(b)) / 2, 6))
    return scored.withColumn("rank", F.row_number().over(w.orderBy("score", tie))).where("rank = 1").drop("rank")


def key_of_value(df: DataFrame, key: str, value: str, sought) -> DataFrame:
    """The smallest key that has the value."""
    return df.where(F.col(value) == sought).agg(F.min(key).alias(key))


def overlay(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows of both, new ones in place of old ones with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def pivot_tracks(tracks: DataFrame, ids: list, value: str = "x") -> DataFrame:
    """A row for each t, a column for each of the named tracks."""
    return tracks.groupBy("t").pivot("obj", ids).agg(F.first(value))


def set_operations(a: Column, b: Column) -> dict[str, Column]:
    """Union, difference and intersection of two id arrays, sorted."""
    return {"both": F.array_sort(F.array_intersect(a, b)), "only_a": F.array_sort(F.array_except(a, b)), "any": F.array_sort(F.array_union(a, b))}
