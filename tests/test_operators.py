import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftnet.functions import geometry as geo
from driftnet.operators import combi, graph, image, joins, reshape, score, series, track
from driftnet.plans import catalog
from driftnet.sources import files


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# Sources and sinks


def test_frames_from_files(spark, tmp_path):
    for i in (3509, 351, 3510, 9):
        (tmp_path / f"img{i}.bmp").write_bytes(image.encode_bmp(np.full((4, 5), i % 200, np.uint8)))
    found = files.list_frames(spark, str(tmp_path), ".bmp", 300, 4000)
    assert [r.frame_id for r in found.orderBy("frame_id").collect()] == [351, 3509, 3510]
    assert rows(files.missing_frames(found, 3508, 3512), "id") == [(3508,), (3511,)]
    frames = files.read_frames(spark, str(tmp_path), ".bmp")
    assert {r.frame_id: (r.h, r.w, r.px[0]) for r in frames.collect()} == {i: (4, 5, i % 200) for i in (3509, 351, 3510, 9)}
    assert spark.range(1).select(files.range_name(F.lit(3), F.lit(45))).first()[0] == "00003-00045"


def test_stage_is_made_once(spark, tmp_path):
    calls = []
    for _ in range(2):
        got = files.stage(spark, str(tmp_path / "s"), lambda: calls.append(1) or spark.range(3))
    assert got.count() == 3 and calls == [1]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 3.0, 4.0, 5)], "frame int, local_id int, x double, y double, area int")
    for _ in range(2):
        files.write_detections(d, str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d")).count() == 2
    t = spark.createDataFrame([(0, 7, 10.0, 20.0), (1, 7, 30.0, 40.0), (0, 8, 5.0, 5.0)], "t int, obj int, x double, y double")
    files.write_tracks(t, [7, 8], str(tmp_path / "t"), 10.0)
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).columns == ["t", "7_cx", "7_cy", "8_cx", "8_cy"]
    nodes = spark.createDataFrame([(1, 10, "a"), (1, 11, "b<")], "family long, node long, label string")
    edges = spark.createDataFrame([(1, 10, 11)], "family long, src long, dst long")
    assert 'label="b&lt;"' in files.graph_xml(nodes, edges).first().xml


# Images


def test_morphology_forms_agree():
    rng = np.random.default_rng(1)
    kernel = np.ones((3, 3), np.uint8)
    for _ in range(5):
        x = (rng.random((5, 5)) > 0.5).astype(np.uint8)
        p = np.pad(x, 1)
        conv = sum(p[i : i + 5, j : j + 5].astype(int) for i in range(3) for j in range(3))
        assert (image.dilate(x * 255, kernel) // 255 == np.clip(conv, 0, 1)).all()
        inner = np.pad(x, 1, constant_values=1)
        conv = sum(inner[i : i + 5, j : j + 5].astype(int) for i in range(3) for j in range(3))
        assert (image.erode(x * 255, kernel) // 255 == np.clip(conv - 9 + 1, 0, 1)).all()


def scene(t, h=60, w=90):
    y, x = np.mgrid[:h, :w]
    img = np.full((h, w), 20, np.uint8)
    for cx, cy, r in ((20 + 3 * t, 20, 8), (60 - 2 * t, 42, 7)):
        img[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = 200
    return img


def test_scene_to_contours(spark):
    frames = spark.createDataFrame([(t, 60, 90, bytearray(scene(t).tobytes())) for t in range(5)], image.FRAME)
    masks = image.per_frame(frames, lambda x: image.binary_pipe(x, np.full((60, 90), 20.0)))
    found = image.contours(masks).collect()
    assert sorted({r.t for r in found}) == list(range(5)) and all(sum(r.t == t for r in found) == 2 for t in range(5))
    ring = np.zeros((20, 20), np.uint8)
    ring[3:17, 3:17], ring[6:14, 6:14], ring[9:11, 9:11] = 255, 0, 255
    parts = image.components(ring)
    assert [(p["parent_id"], p["area"]) for p in parts] == [(None, 132), (0, 60), (1, 4)]
    border = ring.copy()
    border[:8, 0] = 255
    assert image.clear_border(border, 1)[5, 0] == 0 and image.clear_border(border, 1)[4, 4] == 255


@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=1, max_size=7))
@settings(max_examples=100, deadline=None)
def test_labels_are_components(mask):
    m = np.array(mask, np.uint8)
    number = image.label(m)
    seen = np.zeros_like(number)
    k = 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if not seen[y, x]:
            k += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < m.shape[0] and 0 <= b < 7 and m[a, b] and not seen[a, b]:
                    seen[a, b] = k
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert number.max() == k and len({(int(a), int(b)) for a, b in zip(number.ravel(), seen.ravel(), strict=True)}) == len(np.unique(seen))


def test_small_image_operators():
    x = np.arange(20, dtype=np.uint8).reshape(4, 5)
    yy, xx = np.mgrid[:4, :5].astype(float)
    assert (image.undistort(x, xx, yy) == x).all()
    assert image.box_blur(np.full((6, 6), 7.0)).round(9).tolist() == np.full((6, 6), 7.0).tolist()
    assert image.match_template(scene(0), scene(0)[10:30, 15:40]) == (15, 10)
    assert 20 <= image.otsu(scene(0)) < 200 and image.fullness(np.where(scene(0) > 100, 255, 0).astype(np.uint8)) < 0
    assert image.disc(5).sum() in (17, 19, 21) and image.slices(551, 100)[-1] == (500, 551)


# Geometry


def test_moments_and_angles(spark):
    n = 720
    circle = [(50 * np.cos(a) + 9, 50 * np.sin(a) - 4) for a in np.linspace(0, 2 * np.pi, n, endpoint=False)]
    shapes = [(1, [(0, 0), (50, 0), (50, 50), (0, 50)]), (2, circle), (3, circle[::-1]), (4, [(0, 0), (1, 1)])]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in shapes], f"id int, pts {geo.POINTS}")
    m = {r.id: r.m for r in df.select("id", geo.polygon_moments("pts").alias("m")).collect()}
    assert m[1].area == 2500 and (m[1].cx, m[1].cy) == (25, 25) and abs(m[1].mzz - 50**4 / 6) <= 1
    assert abs(m[2].mzz / (np.pi * 50**4 / 2) - 1) < 0.001 and m[2].area == m[3].area and abs(m[3].cx - 9) < 0.01
    assert m[4].area == 0 and m[4].cx is None
    t = spark.range(1).select(geo.triangle_angles(F.lit(3.0), F.lit(4.0), F.lit(5.0)).alias("a"), geo.triangle_angles(F.lit(1.0), F.lit(1.0), F.lit(5.0)).alias("b")).first()
    assert [round(x, 3) for x in t.a] == [36.87, 53.13, 90.0] and t.b is None


def test_hull_and_union(spark):
    pts = spark.createDataFrame([(1, 0, 0), (1, 4, 0), (1, 4, 4), (1, 0, 4), (1, 2, 2), (1, 2, 1), (2, 1, 1)], "k int, x int, y int")
    got = {r.k: [(p.x, p.y) for p in r.hull] for r in geo.convex_hulls(pts, ("k",)).collect()}
    assert set(got[1]) == {(0, 0), (4, 0), (4, 4), (0, 4)} and got[2] == [(1, 1)]
    boxes = spark.createDataFrame([(1, 0, 0, 4, 4), (1, 2, 2, 4, 4), (1, 2, 2, 1, 1), (2, 5, 5, 3, 3)], "k int, x int, y int, w int, h int")
    assert rows(geo.union_area(boxes, ("k",)), "k", "area") == [(1, 28), (2, 9)]


# Joins


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 40), st.integers(0, 15), st.integers(0, 15)), max_size=25), st.sampled_from([4, 16, 100]))
@settings(max_examples=15, deadline=None)
def test_overlap_join_against_brute_force(spark, boxes, cell):
    df = spark.createDataFrame([(t, i, x, y, w, h) for i, (t, x, y, w, h) in enumerate(boxes)], "t int, id int, x int, y int, w int, h int")
    want = [(a, b) for a, p in enumerate(boxes) for b, q in enumerate(boxes) if q[0] == p[0] + 1 and all(p[k] <= q[k] + q[k + 2] and q[k] <= p[k] + p[k + 2] for k in (1, 2))]
    assert rows(joins.overlap_join(df, df, 1, cell), "id_a", "id_b") == sorted(want)


def test_intervals(spark):
    t = {128: [0], 129: [0], 130: [0, 1], 131: [0, 1], 132: [0, 1, 3], 133: [0, 1, 3], 134: [1, 3], 135: [1, 3], 136: [3]}
    active = spark.createDataFrame([(i, k) for k, v in t.items() for i in v], "id int, t int")
    got = {(r.a, r.b): r.ts for r in joins.common_intervals(active).collect()}
    assert got == {(0, 1): [130, 131, 132, 133], (0, 3): [132, 133], (1, 3): [132, 133, 134, 135]}
    amount, test = geo.interval_overlap(("a", "b"), ("c", "d"))
    r = spark.createDataFrame([(0, 1, 8, 10), (1, 3, 3, 7)], "a int, b int, c int, d int").select(amount.alias("n"), test.alias("t")).collect()
    assert [tuple(x) for x in r] == [(-7, False), (0, False)]
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z")], "k int, t int, tag string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50)], "k int, t int, v int")
    assert {r.tag: r.v for r in joins.asof(left, right, ("k",), "t", "v").collect()} == {"x": 50, "y": None, "z": None}


# Graphs


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
@settings(max_examples=8, deadline=None)
def test_components_against_brute_force(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in range(30):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "src int, dst int")
    assert rows(graph.connected_components(df), "node", "component") == sorted(root.items())


def test_rounds_of_few_links_are_few_tasks(spark, monkeypatch):
    rows, plain = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: rows.append(df.rdd.getNumPartitions()) or plain(df))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = graph.connected_components(spark.createDataFrame([(k, k + 1) for k in range(30)] + [(90, 91)], "src long, dst long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(rows[1:]) <= spark.sparkContext.defaultParallelism
    assert dict(got) == {k: 0 for k in range(31)} | {90: 90, 91: 90}


def test_components_of_a_long_path_and_nulls(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(None, 5), (900, 900)], "src int, dst int")
    got = dict(rows(graph.connected_components(path), "node", "component"))
    assert got == {i: 0 for i in range(301)} | {900: 900}


def test_chains_masters_and_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (3, 5), (6, 7), (7, 8), (20, 21), (21, 22), (22, 20), (30, 31)], "src int, dst int")
    assert rows(graph.one_to_one_chains(e), "node", "chain") == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (20, 20), (21, 20), (22, 20)]
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 4)], "slave int, master int")
    assert dict(rows(graph.final_masters(m), "slave", "master")) == {1: 1, 2: 1, 3: 1, 4: 4}
    with pytest.raises(ValueError):
        graph.final_masters(spark.createDataFrame([(1, 2), (2, 1)], "slave int, master int"), max_rounds=5)
    starts, ends = spark.createDataFrame([(1,)], "start int"), spark.createDataFrame([(4,), (5,)], "end int")
    assert {tuple(r.path) for r in graph.simple_paths(e, starts, ends, 5).collect()} == {(1, 2, 3, 4), (1, 2, 3, 5)}
    layers = spark.createDataFrame([(0, 1, 1), (1, 11, 3), (1, 12, 10), (2, 21, 4), (2, 22, 2)], "layer int, id int, v int")
    assert rows(graph.layered_edges(layers, 0, 2, "abs(v_next - v) <= 4"), "src", "dst") == [(1, 11), (11, 21), (11, 22)]
    first = spark.createDataFrame([([1], [4]), ([1, 2, 3], [4, 5]), ([1, 2], [4, 5])], "src_ids array<int>, dst_ids array<int>")
    assert graph.edge_priority(first).first().src_ids == [1, 2, 3]


def test_event_types(spark):
    e = spark.createDataFrame([(1, 3, 5), (2, 3, 5), (3, 4, 2), (5, 6, 9), (5, 7, 9), (8, 10, 3), (8, 11, 3), (9, 11, 3)], "fr int, to int, dist int")
    got = {(r.fr, r.to): r.state for r in graph.event_types(e).collect()}
    assert got == {(1, 3): "merge", (2, 3): "merge", (3, 4): "solo_zp", (5, 6): "split", (5, 7): "split", (8, 10): "beside", (8, 11): "mixed", (9, 11): "beside"}
    mixed = graph.mixed_events(e.where("fr IN (8, 9)")).collect()
    assert [(r.event, r.ins, r.outs) for r in mixed] == [("8,9>10,11", [8, 9], [10, 11])]
    seven = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (3, 5), (4, 5), (2, 6), (3, 6)], "fr int, to int")
    found = {(tuple(r.ins), tuple(r.outs)) for r in graph.mixed_events(seven).collect()}
    assert found == {((1, 2, 3), (4, 6)), ((1, 2, 3), (5, 6)), ((2, 3, 4), (5, 6))}
    names = [r.event for r in graph.mixed_events(seven).collect()]
    assert len(set(names)) == len(names) == 3


# Reshaping and combinatorics


def test_contested_and_redistributions(spark):
    owned = spark.createDataFrame([(487, 1, 2), (487, 1, 5), (489, 2, 0), (489, 2, 2), (487, 3, 5)], "t long, id long, owner long")
    c = reshape.contested(owned)
    assert rows(c.select("t", "id", F.array_join("owners", ",").alias("o")), "t", "id", "o") == [(487, 1, "2,5"), (489, 2, "0,2")]
    v = reshape.redistributions(c)
    assert v.select("variant").distinct().count() == 4
    good = reshape.valid_redistributions(v, owned)
    assert good.select("variant").distinct().count() == 0  # owners 0 and 2 would each need (489, 2)
    nodes = spark.createDataFrame([(1, [2, 1]), (1, [2]), (2, [5])], "t int, ids array<int>")
    assert {r.t: r.ids for r in reshape.disperse(nodes).collect()} == {1: [1, 2, 2], 2: [5]}
    order = spark.createDataFrame([(1, [2]), (2, [1]), (1, [1, 9])], "t int, ids array<int>").orderBy("t", "ids")
    assert [(r.t, *r.ids) for r in order.collect()] == [(1, 1, 9), (1, 2), (2, 1)]


def test_combinatorics(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], [["a1"], ["a2", "b2"], ["a3"]])], "k int, ids array<int>, lists array<array<string>>")
    r = df.select(combi.power_set("ids").alias("p"), combi.product_size("lists").alias("n")).first()
    assert sorted(x.subset for x in combi.subsets(df, (), "ids").collect()) == sorted(r.p)
    assert len(r.p) == 15 and r.p[:5] == [[1], [2], [3], [4], [1, 2]] and r.n == 2
    assert sorted(tuple(x.choice) for x in combi.cartesian(df, ("k",), "lists").collect()) == [("a1", "a2", "a3"), ("a1", "b2", "a3")]
    parts = combi.distribute(df, "ids", 2).collect()
    assert len(parts) == 14 and all(p.parts[0] and p.parts[1] for p in parts)
    target = spark.createDataFrame([(1, 5.0, 0.0, 20.0, [(1, 0.0, 0.0, 10.0), (2, 10.0, 0.0, 10.0), (3, 90.0, 0.0, 10.0)])], "k int, tx double, ty double, tarea double, parts array<struct<id:int,x:double,y:double,area:double>>")
    assert combi.best_subset(target, ("k",), 20, 0.6).first().ids == [1, 2]


# Series, scores and tracking


def test_extrapolation_of_three_points(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 2.0), (1, 3, 2.0, 4.0), (2, 1, 0.0, 0.0), (2, 2, 10.0, 0.0), (2, 3, 0.0, 0.0)], "obj int, t int, x double, y double")
    got = {(r.obj, r.t): r for r in series.extrapolate3(df).collect()}
    assert (got[1, 3].x_next, got[1, 3].y_next) == (3.0, 6.0) and got[1, 2].x_next is None
    e = np.array([-10 / 3, 20 / 3, -10 / 3])
    k = 1 - np.sqrt(5 / (e**2).sum())
    assert abs(got[2, 3].x_next - (2 * (10 / 3 + e[2] * k) - (10 / 3 + e[1] * k))) < 1e-9
    rings = {r.t: r.ring for r in series.ring_buffer(df.where("obj = 1"), "x", 2).collect()}
    assert rings == {1: [0.0], 2: [0.0, 1.0], 3: [1.0, 2.0]}


def test_two_choices_with_equal_scores(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 9.0), (1, 0, 1, 2.0, 8.0)], "c int, branch int, choice int, a double, b double")
    assert score.min_max_score(df, "c", "branch", "choice", "a", "b").first().choice == 1


def test_branches_follow_their_objects(spark):
    known = [(1, b, t, 10.0 * t, 100.0 * b, 50.0) for b in (0, 1) for t in (1, 2, 3)]
    found = [(1, t, 10 * t + b, 10.0 * t, 100.0 * b, 50.0) for b in (0, 1) for t in (4, 5)] + [(1, 5, 59, 50.0, 101.0, 5.0)]
    k = spark.createDataFrame(known, "event long, branch long, t int, x double, y double, area double")
    c = spark.createDataFrame(found, "event long, t int, id long, x double, y double, area double")
    got = {(r.branch, r.t): sorted(r.ids) for r in track.extrapolate_branches(k.select("event").distinct(), k, c).collect()}
    assert got == {(0, 4): [40], (1, 4): [41], (0, 5): [50], (1, 5): [51, 59]}


def test_branches_take_the_best_of_all_deals(spark):
    single = [(1, 0, t, 10.0 * t, 0.0, 50.0) for t in (1, 2, 3)]
    many = [(2, b, t, 10.0 * t, 100.0 * b, 50.0) for b in range(5) for t in (1, 2, 3)]
    found = [(1, 4, 1, 40.0, 0.0, 50.0), (1, 4, 2, 900.0, 900.0, 50.0)] + [(2, 4, b, 40.0, 100.0 * b, 50.0) for b in range(5)]
    k = spark.createDataFrame(single + many, "event long, branch long, t int, x double, y double, area double")
    c = spark.createDataFrame(found, "event long, t int, id long, x double, y double, area double")
    got = {(r.event, r.branch): r.ids for r in track.extrapolate_branches(k.select("event").distinct(), k, c).collect()}
    assert got == {(1, 0): [1], **{(2, b): [b] for b in range(5)}}


def test_connections_are_rewritten(spark):
    nodes = spark.createDataFrame([(1, 1, [5]), (1, 2, [6]), (2, 4, [8]), (3, 9, [1])], "seg int, t int, ids array<int>")
    filled = spark.createDataFrame([(1, 2, 2, [6, 7]), (1, 2, 3, [7])], "fr int, to int, t int, ids array<int>")
    new, named = track.save_connection(nodes, filled)
    assert rows(new.select("seg", "t", F.array_join("ids", ",").alias("i")), "seg", "t", "i") == [(1, 1, "5"), (1, 2, "6,7"), (1, 3, "7"), (1, 4, "8"), (3, 9, "1")]
    links = spark.createDataFrame([(10, 11), (11, 12), (12, 13)], "src int, dst int")
    edge = spark.createDataFrame([(1, 2, 10, 13, 1, 4)], "fr int, to int, fr_node int, to_node int, t_end int, t_start int")
    stray = spark.createDataFrame([(11, 2), (12, 3), (99, 2)], "node int, t int")
    web = {r.t: r.ids for r in track.stray_web(edge, stray, links).collect()}
    assert web == {1: [10], 2: [11], 3: [12], 4: [13]}
    assert track.collage_grid(6, 10, 10, 1.5) == (3, 2)


def test_evolutions_and_resolution(spark):
    choices = [(1, 1, [1], 0.0, 0.0, 10.0), (1, 2, [2], 1.0, 0.0, 10.0), (1, 2, [2, 3], 5.0, 0.0, 90.0), (1, 3, [4], 2.0, 0.0, 11.0)]
    df = spark.createDataFrame(choices, "edge long, t int, ids array<long>, x double, y double, area double")
    assert track.evolutions(df).select("evol").distinct().count() == 2
    pruned = track.evolutions(df, most=1).collect()
    assert [sorted(r.ids) for r in sorted(pruned, key=lambda r: r.t)] == [[1], [2], [4]]
    web = spark.createDataFrame([(1, 1, [1]), (1, 2, [2, 3]), (1, 3, [4])], "edge long, t int, ids array<long>")
    contours = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0), (2, 2, 1.0, 0.0, 10.0), (2, 3, 40.0, 9.0, 80.0), (3, 4, 2.0, 0.0, 11.0)], "t int, id long, x double, y double, area double")
    best = {r.t: r.ids for r in track.resolve_connections(web, contours, "best_evolution").collect()}
    assert best == {1: [1], 2: [2], 3: [4]}
    assert {r.t: r.ids for r in track.resolve_connections(web, contours).collect()} == {1: [1], 2: [2, 3], 3: [4]}


def test_annotated_frames_and_masks(spark):
    frames = spark.createDataFrame([(1, 6, 8, bytearray(48)), (2, 6, 8, bytearray(48))], image.FRAME)
    boxes = spark.createDataFrame([(1, 1, 1, 4, 3), (1, -2, -2, 4, 4), (2, 90, 9, 3, 3)], "t int, x int, y int, w int, h int")
    got = {r.frame_id: np.frombuffer(r.px, np.uint8).reshape(6, 8) for r in image.annotate(frames, boxes).collect()}
    assert got[1][1, 1] == got[1][3, 4] == 255 and got[1][5].sum() == 0 and got[2].sum() == 0
    assert image.gray_to_rgb(got[1]).shape == (6, 8, 3)


def test_isolated_and_solo_time(spark):
    paths = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (2, 21)], "path int, node int")
    links = spark.createDataFrame([(10, 11), (20, 21), (21, 99)], "src int, dst int")
    assert rows(track.isolated_connections(paths, links), "path") == [(1,)]
    info = spark.createDataFrame([(1, t, list(range(n))) for t, n in ((5, 1), (6, 1), (7, 2), (8, 1), (9, 1))], "event int, t int, ids array<int>")
    ends = spark.createDataFrame([(1, 4)], "event int, t_end int")
    assert rows(track.solo_time_extension(info, ends), "t") == [(8,), (9,)]
    segs = spark.createDataFrame([(1, 0, 4), (2, 6, 9), (3, 5, 7)], "id int, start int, stop int").withColumn("family", F.lit(1))
    assert rows(track.interval_layers(segs), "id", "layer") == [(1, 0), (2, 1), (3, 0)]


def test_catalysts_connect_but_do_not_appear(spark):
    edges = spark.createDataFrame([(1, 2), (7, 8)], "src int, dst int")
    catalysts = spark.createDataFrame([(2, 100), (100, 7), (9, 101)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 7, 8, 9)], "node int")
    assert rows(graph.components_with_catalysts(edges, catalysts, nodes), "node", "component") == [(1, 1), (2, 1), (7, 1), (8, 1), (9, 9)]


def test_all_choices_of_long_lists(spark):
    df = spark.createDataFrame([(1, [list(range(20))] * 3)], "k int, lists array<array<int>>")
    got = combi.cartesian(df, ("k",), "lists").selectExpr("concat_ws(',', choice) AS c")
    assert got.count() == got.distinct().count() == 8000


def test_set_partitions_are_whole(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [5]), (3, [1, 2, 3, 4, 5])], "k int, ids array<int>")
    got = combi.distribute(df, "ids", 3).collect()
    for k, ids in ((1, [1, 2, 3]), (3, [1, 2, 3, 4, 5])):
        mine = [tuple(map(tuple, r.parts)) for r in got if r.k == k]
        assert len(mine) == len(set(mine)) == len(combi.set_partitions(len(ids), 3)) and all(sorted(sum(p, ())) == ids for p in mine)
    assert not [r for r in got if r.k == 2]


def test_path_failures(spark):
    e = spark.createDataFrame([(1, 3), (2, 4), (3, 5), (8, 9)], "src long, dst long")
    starts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 8), ("c", 5)], "event string, start long")
    ends = spark.createDataFrame([("a", 5), ("a", 4), ("b", 5), ("c", 5)], "event string, end long")
    paths = graph.simple_paths(e, starts, ends, 5)
    got = {tuple(r) for r in graph.path_failures(paths, starts, ends).collect()}
    assert got == {("a", 1, 1, True), ("a", 2, 1, True), ("b", 1, 0, False), ("b", 8, 1, False), ("c", 5, 0, False)}
    assert {tuple(r) for r in graph.path_failures(paths, starts, ends.limit(0)).collect()} == {(*map(r.__getitem__, ("event", "start")), 0, False) for r in starts.collect()}


def test_reach_back_stops_at_time(spark):
    e = spark.createDataFrame([(1, 2, 0), (2, 3, 1), (3, 4, 2), (9, 4, 2)], "src long, dst long, src_t int")
    starts = spark.createDataFrame([(4,), (1,)], "start long")
    assert {tuple(r) for r in graph.reachable_back_by_time(e, starts, 0, 5).collect()} == {(4, 4, 0), (4, 3, 1), (4, 9, 1), (4, 2, 2), (1, 1, 0)}


def test_distance_matrix_is_symmetric(spark):
    rows = [(1, k, [(x, 0), (x + 3, 0), (x + 3, 4), (x, 4)]) for k, x in ((1, 0), (2, 10), (3, 30))] + [(2, 4, [(0, 0)])]
    df = spark.createDataFrame(rows, "g int, id long, pts array<struct<x int, y int>>")
    got = {(r.id, r.id_other): r.d for r in geo.distance_matrix(df, ("g",)).collect()}
    assert got == {(1, 2): 7, (2, 1): 7, (2, 3): 17, (3, 2): 17, (1, 3): 27, (3, 1): 27}


def test_interval_lookups_against_loops(spark):
    import random

    rng = random.Random(2)
    gaps = [(k, t, t + rng.randint(0, 9)) for k in (1, 2) for t in rng.sample(range(60), 9)] + [(1, 5, 5), (1, 5, 9)]
    nodes = [(rng.randint(1, 3), rng.randint(0, 70), i, rng.choice([None, -1, 4])) for i in range(200)]
    got = joins.nodes_in_interval(spark.createDataFrame(nodes, "k int, t int, id int, owner int"), spark.createDataFrame(gaps, "k int, t_min int, t_max int"), ("k",))
    want = {n for n in nodes if n[3] != 4 and any(k == n[0] and a < n[1] < b for k, a, b in gaps)}
    assert {tuple(r) for r in got.select("k", "t", "id", "owner").collect()} == want
    holes = [(c, t, t + 6, rng.uniform(-20, 20), rng.uniform(-20, 20), 0.0, 50.0) for c, t in enumerate(rng.sample(range(40), 12))]
    stray = [(rng.randint(0, 46), i, rng.uniform(-25, 25), rng.uniform(-25, 25), rng.uniform(0, 60)) for i in range(600)]
    found = joins.frozen_strays(spark.createDataFrame(holes, "cluster int, t_from int, t_to int, x double, y double, area_low double, area_high double"), spark.createDataFrame(stray, "t int, id int, x double, y double, area double"), 5.0)
    want = {(c, t, i) for c, a, b, hx, hy, lo, hi in holes for t, i, x, y, s in stray if a <= t <= b and lo <= s <= hi and (x - hx) ** 2 + (y - hy) ** 2 <= 25}
    rows_ = [tuple(r) for r in found.collect()]
    assert set(rows_) == want and len(rows_) == len(want) and len(want) > 5


def test_best_evolutions_against_all_ways(spark):
    import random

    rng = random.Random(8)
    choices = []
    for edge in range(40):
        for t in range(rng.randint(1, 5)):
            ids = rng.sample(range(9), rng.randint(1, 2 if edge % 2 else 3))
            subsets = [[x for i, x in enumerate(ids) if m >> i & 1] for m in range(1, 1 << len(ids))]
            # half of the edges have grids of places and areas, where criteria agree on a way
            value = (lambda: float(rng.randint(0, 2))) if edge % 4 < 2 else (lambda: rng.uniform(0, 50))
            choices += [(edge, 3 * t, sorted(x), value(), value(), value() + 1) for x in subsets]
    df = spark.createDataFrame(choices, "edge long, t int, ids array<long>, x double, y double, area double")
    w = Window.partitionBy("edge", "evol")
    end = lambda f, c: f(c, "t").over(w)
    share = (F.col("t") - F.min("t").over(w)) / F.greatest(F.max("t").over(w) - F.min("t").over(w), F.lit(1))
    line = lambda c: end(F.min_by, c) + (end(F.max_by, c) - end(F.min_by, c)) * share
    ways = track.evolutions(df, most=100_000).withColumns({"ix": line("x"), "iy": line("y"), "moment": F.col("area") ** 2}).cache()
    chosen = score.weighted_vote(score.evolution_criteria(ways), ("inter_mean", "move_mean", "area_mean", "moment_mean"))
    want = {(r.edge, r.t): list(r.ids) for r in ways.join(chosen.select("edge", "evol"), ["edge", "evol"]).collect()}
    got = {(r.edge, r.t): list(r.ids) for r in track.best_evolutions(df).collect()}
    assert got == want
    long = spark.createDataFrame([(1, t, [i], float(t + 7 * i), float(i), 10.0 + i) for t in range(40) for i in range(5)], df.schema)  # 5^40 ways
    assert {r.t: r.ids for r in track.best_evolutions(long).collect()} == {t: [0] for t in range(40)}


def test_sole_links_against_all_pairs(spark, monkeypatch):
    """Few and many boxes a frame: the links whose boxes touch no other, of which boxes in crowds are left out before the join."""
    rng = np.random.default_rng(7)
    rows = [(int(t), 1000 * int(t) + i, int(rng.integers(0, side)), int(rng.integers(0, side)), int(rng.integers(1, 50)), int(rng.integers(1, 50))) for t, n, side in ((1, 40, 900), (2, 40, 250), (3, 200, 150), (4, 60, 900), (5, 30, 900)) for i in range(n)]
    touch = lambda a, b: a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]
    pairs = [(a[1], b[1]) for a in rows for b in rows if b[0] == a[0] + 1 and touch(a, b)]
    outs, ins = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    want = sorted(p for p in pairs if outs[p[0]] == 1 and ins[p[1]] == 1)
    boxes = spark.createDataFrame(rows, "t int, id long, x int, y int, w int, h int")
    joined, whole = [], joins.overlap_join
    monkeypatch.setattr(joins, "overlap_join", lambda a, b, *more: joined.append((a, b)) or whole(a, b, *more))
    assert want and sorted(map(tuple, joins.sole_links(boxes, boxes, 1).collect())) == want
    assert joined[0][0].where("t = 2").count() < 40  # the crowd of frame 3 covers tiles twice
    again = spark.createDataFrame([*pairs, *pairs, (None, 1), (2, None)], "src long, dst long")
    assert sorted(map(tuple, graph.one_to_one_edges(again).collect())) == want


def test_near_another_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(-40, 40), rng.uniform(-40, 40)) for k in range(60)] + [(100 + k, 3.0 + k / 1000, 4.0) for k in range(300)] + [(900, -90.0, 0.0), (901, -82.0, 0.0), (902, -73.9, 0.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    want = {a for a, x, y in rows for b, u, v in rows if a != b and ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 8.0}
    got = [r.id for r in joins.near_another(points, 8.0).collect()]
    assert set(got) == want and len(got) == len(want) and 902 not in want
    tracks = points.crossJoin(spark.range(3).select(F.col("id").alias("t"))).withColumnRenamed("id", "obj").withColumn("area", F.lit(1.0))
    assert {r.obj for r in track.remove_frozen(tracks, 5.0, 8.0).collect()} == {a for a, _, _ in rows} - want


def test_still_tracks_go_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(track, "connected_components", lambda *_: pytest.fail("pairs are formed"))
    tracks = spark.createDataFrame([(o, t, 1.0, 1.0 + 50 * (o == 9), 1.0) for o in (1, 2, 9) for t in range(3)], "obj long, t int, x double, y double, area double")
    assert {r.obj for r in track.remove_frozen(tracks, 5.0, 8.0).collect()} == {9}


def test_target_hits_pair_once(spark):
    ours = spark.createDataFrame([(1, 5, [3, 4, 9]), (2, 5, [4, 4]), (3, 6, [1]), (3, 6, [1])], "seg long, t int, ids array<long>")
    targets = spark.createDataFrame([(7, 5, [9, 4, 3]), (8, 5, [4, 4, 5]), (8, 5, [4, 4, 5]), (9, 5, [1])], "target long, t int, ids array<long>")
    hits = joins.target_hits(ours, targets)
    assert sorted(map(tuple, hits.collect())) == [(1, 7, 5, "full"), (1, 8, 5, "partial"), (2, 7, 5, "partial"), (2, 8, 5, "partial")]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join", 1)[0]  # pairs are not shuffled to be told apart


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_moments_and_box_of_a_row_without_a_shuffle_of_points(spark):
    df = catalog.polygon_moments(spark, "/root/testdata/sf0.001")
    assert "Generate" not in plan_of(df) and plan_of(df).count("Window") <= 1
    row = spark.createDataFrame([([(1.0, 2.0), (4.0, 9.0), (-3.0, 5.0)],)], f"pts {geo.POINTS}").select(geo.box_of_list("pts").alias("b")).first().b
    assert tuple(row) == (-3.0, 2.0, 8.0, 8.0)


def test_union_area_joins_squares_before_the_shuffle(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(-30, 30), rng.randint(-30, 30), rng.choice([0, 1, 7, 8, 9, 16, 40]), rng.choice([1, 7, 8, 9, 40, 64])) for k in range(6) for _ in range(k * 3 + 1)]
    want = {}
    for k, x, y, w, h in rows:
        want.setdefault(k, set()).update((a, b) for a in range(x, x + w) for b in range(y, y + h))
    got = geo.union_area(spark.createDataFrame(rows, "k int, x int, y int, w int, h int"), ("k",))
    assert {r.k: r.area for r in got.collect()} == {k: len(v) for k, v in want.items() if v}
    assert "Window" not in plan_of(got)  # no sort of all columns of all boxes


def test_hulls_and_ellipses_make_no_object_a_point(spark):
    rows = [(k, float(x), float(y)) for k in range(3) for x in range(5) for y in range(k + 2)]
    hulls = geo.convex_hulls(spark.createDataFrame(rows, "k int, x double, y double"), ("k",))
    found = geo.ellipses(hulls, ("k",))
    assert "ArrowEvalPython" not in plan_of(found)
    for r in hulls.join(found, "k").collect():
        want = geo.fit_ellipse(geo.resample(geo.hull(np.array([(x, y) for k, x, y in rows if k == r.k])), 64))
        assert np.allclose((r.cx, r.cy, r.major, r.minor, r.angle), want)
    assert geo.convex_hulls(spark.createDataFrame([], "k int, x double, y double"), ("k",)).count() == 0


def test_two_bins_are_dealt_by_shifts(spark):
    got = combi.distribute(spark.createDataFrame([(1, [5, 6, 7]), (2, [8])], "k int, ids array<int>"), "ids", 2)
    want = {(tuple(i for i, b in zip([5, 6, 7], bins, strict=True) if not b), tuple(i for i, b in zip([5, 6, 7], bins, strict=True) if b)) for bins in combi.set_partitions(3, 2)}
    assert {tuple(map(tuple, r.parts)) for r in got.collect()} == want and "shiftright" in plan_of(got)


def test_box_families_against_all_pairs(spark, monkeypatch):
    """Equal to components over all touching pairs, in sparse and crowded frames, for boxes of no size, beyond zero and over many cells; and in a crowd no row for each pair is shuffled."""
    rng = random.Random(6)
    for n, ground, most in ((80, 200, 12), (200, 120, 9), (60, 60, 30), (40, 300, 150)):
        rows = [(rng.randrange(3), 1000 - i, rng.randrange(-ground // 2, ground), rng.randrange(-ground // 2, ground), rng.randrange(most), rng.randrange(most)) for i in range(n)]
        root = {r[1]: r[1] for r in rows}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        touching = set()
        for a in rows:
            for b in rows:
                if a[0] == b[0] and a[1] < b[1] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]:
                    low, high = sorted((find(a[1]), find(b[1])))
                    root[high] = low
                    touching |= {a[1], b[1]}
        df = spark.createDataFrame(rows, "t int, id long, x int, y int, w int, h int")
        for cell, matched in ((16, 2), (64, 768)):
            monkeypatch.setattr(joins, "MATCHED", matched)
            assert {tuple(r) for r in graph.box_families(df, cell=cell).collect()} == {(i, find(i)) for i in root}
            assert {tuple(r) for r in graph.box_families(df, single=False, cell=cell).collect()} == {(i, find(i)) for i in touching}
    crowd = spark.createDataFrame([(0, i, i % 40, i % 37, 20, 20) for i in range(1500)], "t int, id long, x int, y int, w int, h int")
    rows, links = joins.touch_groups(crowd, 32)
    assert rows.count() == 1500 and links.count() <= 16
    assert {r.component for r in track.first_pass(crowd, 10).select(F.col("cluster").alias("component")).collect()} == {0}
