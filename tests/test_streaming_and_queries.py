import duckdb
import pandas as pd
import pytest

import __spark_entry__
from driftnet.operators import series
from driftnet.plans import catalog
from driftnet.streaming import tracker

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def stream_of(spark, tmp_path, df, parts, order):
    """``df`` as a stream of files, a batch each."""
    for k in range(parts):
        df.where(f"{order} % {parts} = {k}" if order == "obj" else f"floor({order} / 4) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(stream, name, spark, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_still_objects_as_in_batch(spark, tmp_path):
    rows = [(o, t, (0.3 * (t % 2) if o == 1 else 9.0 * t), float(o)) for o in (1, 2) for t in range(12)]
    df = spark.createDataFrame(rows, "obj long, t int, x double, y double")
    got = drain(tracker.still_objects(stream_of(spark, tmp_path, df, 3, "t")), "still", spark, tmp_path)
    want = series.frozen_recent(df).select("obj", "t", "still")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tracker_keeps_names(spark, tmp_path):
    rows = [(1, t, 10 * t + k, 10.0 * t + 300 * k, 5.0 * t, 9.0) for t in range(8) for k in (0, 1)]
    df = spark.createDataFrame(rows, "cell long, t int, id long, x double, y double, area double")
    got = drain(tracker.track_steps(stream_of(spark, tmp_path, df, 2, "t")), "tracks", spark, tmp_path).collect()
    assert {(r.id % 10, r.track) for r in got} in ({(0, 1), (1, 2)}, {(0, 2), (1, 1)}) and len(got) == 16


def test_split_persistence_and_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, t, float(3 * t)) for t in range(6)], "obj long, t int, d double")
    got = drain(tracker.split_persistence(stream_of(spark, tmp_path, df, 2, "t")), "splits", spark, tmp_path)
    want = series.split_persistence(df).select("obj", "t", "confirmed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    q = tracker.write_csv(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.csv(str(tmp_path / "out")).count() == 6


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(frame):
    def one(v):
        if pd.isna(v):
            return "-"
        return str(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in tuple("iuf") else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False))


def test_steps_know_their_segments_without_a_join(spark, monkeypatch):
    given, plain = [], catalog.rewrite.rewrite
    monkeypatch.setattr(catalog.rewrite, "rewrite", lambda *x: given.extend(x) or plain(*x))
    catalog.QUERIES["rewritten_node_edges"](spark, SF)
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in given[:2])
    segs, steps = catalog.src.segments(spark, SF), catalog.src.steps(spark, SF)
    want = segs.join(steps, "obj").where("step BETWEEN t_start AND t_end").select("obj", "step", "seg")
    assert sorted(catalog.src.numbered_steps(spark, SF).select("obj", "step", "seg").collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert canonical(got) == canonical(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)
