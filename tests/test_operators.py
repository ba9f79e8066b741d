import math
import random

import pytest

from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.functions import text as tx
from plumbline.operators import graph, neighbours, points, ranking, raster, relational, sequences, spatial, stateful, statistics, suppression


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tile_starts(spark):
    cases = {1200: [0, 384, 688], 512: [0], 300: [0], 896: [0, 384], 1000: [0, 384, 488]}
    for size, want in cases.items():
        got = _one(spark, sequences.tile_starts(F.lit(size), 512, 128).alias("x"))["x"]
        assert got[0] == 0 and got[-1] == max(0, size - 512)
        if size != 1000:
            assert got == want, size


def test_geometry(spark):
    assert _one(spark, *[g.utm_epsg(F.lit(a), F.lit(b)).alias(str(i)) for i, (a, b) in enumerate([(43.0, 1.0), (-33.0, 18.0), (0.0, 180.0)])]) == (32631, 32734, 32660)
    metres = _one(spark, g.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0]
    assert math.isclose(metres, math.radians(1) * g.EARTH_RADIUS, rel_tol=1e-12)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3)]])
    row = _one(spark, g.ring_area(ring), g.point_in_ring(F.lit(1.0), F.lit(1.0), ring), g.point_in_ring(F.lit(5.0), F.lit(1.0), ring), g.circular_difference(F.lit(350.0), F.lit(10.0)))
    assert row == (12.0, True, False, 20.0)
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert _one(spark, g.boxes_touch(box(0, 0, 1, 1), box(1, 1, 2, 2)), g.box_iou(box(0, 0, 2, 2), box(1, 0, 3, 2)))[1] == 1 / 3
    x, y, z = 1_234_567, 99, 2_000_001
    want = sum(((v >> i) & 1) << (3 * i + k) for k, v in enumerate((x, y, z)) for i in range(21))
    assert _one(spark, g.morton(F.lit(x), F.lit(y), F.lit(z)))[0] == want
    q = _one(spark, g.quantise(F.lit(0.5), F.lit(0.0), F.lit(1.0), 5), g.quantise(F.lit(1.0), F.lit(1.0), F.lit(1.0)), g.sigmoid(F.lit(-800.0)))
    assert q == (2, 0, 0.0)  # half to even


def test_text(spark):
    row = _one(
        spark, tx.label(F.lit("  Roof-Top__A ")), tx.colour(F.lit("#A0B1C2")), tx.colour(F.lit("red")), tx.epsg(F.lit(" epsg:32631")), tx.sequence_number(F.lit("DJI_0042_V.JPG")),
        tx.safe_segment(F.lit("../x")), tx.retry_delay(F.lit(4), 2.0, 10.0), tx.gps_time(F.lit(2000), F.lit(18)).cast("long"), tx.tags(F.array(F.lit(" a "), F.lit("a"), F.lit(""), F.lit("b")), 2),
    )
    assert tuple(row)[:7] == ("roof top a", "#a0b1c2", None, "EPSG:32631", 42, False, 10.0)
    assert row[7] == 315_964_800 + 2000 * 604_800
    assert row[8] == ["a", "b"]


def test_k_nearest_is_exact(spark):
    rng = random.Random(1)
    points = [(i, rng.random() * 10, rng.choice([0.0, rng.random() * 100])) for i in range(120)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {(r["a"], r["rank"]): r["b"] for r in spatial.k_nearest(df, "id", "x", "y", 5, 0.5).collect()}
    for i, x, y in points:
        near = sorted((math.hypot(x - u, y - v), j) for j, u, v in points if j != i)[:5]
        assert [got[i, k + 1] for k in range(5)] == [j for _, j in near]
    assert spatial.k_nearest(df.limit(1), "id", "x", "y", 5, 0.5).count() == 0


def test_nearest_with_copies_lines_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 4)
    rng = random.Random(8)
    places = [(rng.random(), rng.random()) for _ in range(150)] + [(i / 4, float(i % 3)) for i in range(90)] + [(50.0, 60.0), (-0.0, 7.0), (0.0, 7.0)]
    spots = [p for i, p in enumerate(places) for _ in range((1, 1, 3, 9)[i % 4])] + [(2.0, 2.0)] * 60
    rows = [(i * 7919 % 10007, *p) for i, p in enumerate(spots)]
    df = spark.createDataFrame([*rows, (20000, None, 1.0), (20001, float("nan"), 1.0)], "id long, x double, y double")
    for radius in (None, 0.3):
        want = {}
        for a, x, y in rows:
            d = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), b) for b, u, v in rows if a != b)
            want |= {(a, n): p for n, p in enumerate(d[:4], 1) if radius is None or p[0] <= radius}
        found = spatial.k_nearest(df, "id", "x", "y", 4) if radius is None else spatial.radius_top_k(df, "id", "x", "y", radius, 4)
        got = found.collect()
        assert {(r["a"], r["rank"]): (r["distance"], r["b"]) for r in got} == want and len(got) == len(want)


def test_overlapping_pairs_of_any_size(spark):
    rng, boxes = random.Random(4), []
    for i in range(160):
        x, y, w, h = rng.random() * 500, rng.random() * 500, rng.choice([2, 70, 90, 900, 5000]), rng.choice([2, 66, 70, 900, 1000])
        boxes.append((i, "pq"[i % 2], x, y, x + w * rng.uniform(0.8, 1.2), y + h * rng.uniform(0.8, 1.2)))

    def iou(p, q):
        inter = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        return inter / ((p[4] - p[2]) * (p[5] - p[3]) + (q[4] - q[2]) * (q[5] - q[3]) - inter)

    df = spark.createDataFrame(boxes, "id long, cls string, x0 double, y0 double, x1 double, y1 double")
    for least in (0.05, 0.4):
        want = sorted((p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and p[1] == q[1] and iou(p, q) >= least)
        got = spatial.overlapping_pairs(df, "id", ["cls"], ("x0", "y0", "x1", "y1"), 1.0, least).collect()
        assert sorted((r["a"], r["b"]) for r in got) == want and len(want) > 20


def test_overlapping_pairs_of_copies(spark, monkeypatch):
    places = [(0.0, 0.0), (0.2, 0.0), (5.0, 5.0), (5.0, 5.1)]
    boxes = [(i * 13 % 101, "pq"[i % 8 // 4], x, y, x + 1, y + (i % 4 != 3)) for i in range(64) for x, y in [places[i % 4]]] + [(500, None, 0.0, 0.0, 1.0, 1.0)]
    met, inner = [], spatial._unlike_pairs
    monkeypatch.setattr(spatial, "_unlike_pairs", lambda df, *rest: met.append(df.count()) or inner(df, *rest))
    df = spark.createDataFrame(boxes, "id long, cls string, x0 double, y0 double, x1 double, y1 double")
    got = [(r["cls"], r["a"], r["b"], round(r["iou"], 6)) for r in spatial.overlapping_pairs(df, "id", ["cls"], ("x0", "y0", "x1", "y1"), 1.0, 0.4).collect()]
    want = []
    for p in boxes:
        for q in boxes:
            both = (min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3])) if p[4] > q[2] and q[4] > p[2] else 0
            if p[0] < q[0] and p[1] and p[1] == q[1] and both and both / (2 - both) >= 0.4:
                want.append((p[1], p[0], q[0], round(both / (2 - both), 6)))
    # Nine boxes meet, not 65.
    assert sorted(got) == sorted(want) and len(got) > 200 and met == [9]


def test_suppression_is_the_greedy_one(spark):
    rng = random.Random(2)
    n, pairs = 80, {tuple(sorted(rng.sample(range(80), 2))) for _ in range(150)}
    items = spark.createDataFrame([(i, (i * 37) % n) for i in range(n)], "id long, r long")
    got = {r["id"]: r["kept"] for r in graph.suppress(items, "id", "r", spark.createDataFrame(list(pairs), "a long, b long")).collect()}
    kept = set()
    for i in sorted(range(n), key=lambda i: (i * 37) % n):
        if not any(tuple(sorted((i, k))) in pairs for k in kept):
            kept.add(i)
    assert got == {i: i in kept for i in range(n)}


def test_boxes_are_suppressed_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(suppression, "BLOCK_BOXES", 60)
    rng, boxes = random.Random(12), []
    for i in range(400):
        x, y, w, h = rng.random() * 20, rng.random() * 20, rng.choice([1, 2, 9, 0]), rng.choice([1, 2, 8])
        boxes.append((i, "pq"[i % 2], x, y, x + w, y + h))
    boxes += [(1000 + i, "p", i * 0.3, 5.0, i * 0.3 + 1.0, 6.0) for i in range(60)]  # a chain through all blocks
    boxes += [(2000 + i * 31 % 97, "q", *boxes[i % 5 * 2 + 1][2:]) for i in range(90)]
    area = lambda p: (p[4] - p[2]) * (p[5] - p[3])

    def iou(p, q):
        inter = max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        return inter / (area(p) + area(q) - inter) if inter else 0

    kept = []
    for p in sorted(boxes, key=lambda p: (-area(p), p[0])):
        if not any(q[1] == p[1] and iou(p, q) >= 0.3 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(boxes, "id long, cls string, w double, s double, e double, n double").withColumn("area", F.expr("(e - w) * (n - s)"))
    got = [r["id"] for r in suppression.first_of_boxes(df, "cls", [-F.col("area"), F.col("id")], 0.3).collect()]
    assert sorted(got) == sorted(p[0] for p in kept) and 50 < len(got) < 500


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (3, 4)], "a long, b long")
    assert {r["node"] for r in graph.in_cycles(edges, "a", "b").collect()} == {1, 2, 3}
    assert graph.in_cycles(edges.where("a > 3"), "a", "b").count() == 0
    nodes = spark.range(1, 9)
    found = {r["node"]: r["component"] for r in graph.components(nodes, "id", edges, "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 7)}, 7: 7, 8: 8}
    reach = {r["node"]: r["depth"] for r in graph.reachable(edges, spark.createDataFrame([(4,)], "r long"), "a", "b").collect()}
    assert reach == {4: 0, 5: 1, 6: 2}


def test_global_rank(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v")).repartition(5)
    got = [r["v"] for r in ranking.global_rank(df, [F.col("v")], "n").orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert [r["n"] for r in ranking.global_rank(df, [F.col("v")], "n").orderBy("n").collect()] == list(range(1, 1001))


def test_token_bucket(spark):
    rows = [(1, "a", 0.0), (2, "a", 0.0), (3, "a", 0.0), (4, "a", 1.0), (5, "b", 5.0), (6, "a", 0.5)]
    df = spark.createDataFrame(rows, "id long, k string, at double")
    got = {r["id"]: r["allowed"] for r in stateful.token_bucket(df, "k", "at", ["id"], 1.0, 2.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_statistics_edge_cases(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (3.0,), (None,)], "x double")
    row = statistics.describe(df, [], F.col("x")).first()
    assert (row["n"], row["mean"], row["std"], row["min"]) == (2, 2.0, 1.0, 1.0)
    empty = statistics.describe(df.limit(0), [], F.col("x")).first()
    assert empty["n"] == 0 and empty["mean"] is None


def test_relational(spark):
    paths = spark.createDataFrame([("a/b/c/d",), ("a/x",), ("q",)], "path string")
    prefixes = spark.createDataFrame([("a",), ("a/b",), ("a/b/c2",)], "p string")
    got = {r["path"]: r["p"] for r in relational.longest_prefix(paths, "path", prefixes, "p").collect()}
    assert got == {"a/b/c/d": "a/b", "a/x": "a", "q": None}
    first, second = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(9,), (8,)], "id long")
    assert [r["id"] for r in relational.append_with_limit(first, second, ["id"], 3).collect()] == [1, 2, 8]


def test_bilinear(spark):
    raster = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row long, col long, v double")
    points = spark.createDataFrame([(0.5, 0.5), (1.0, 1.0), (2.5, 0.0)], "x double, y double")
    got = {(r["x"], r["y"]): r["value"] for r in spatial.bilinear(points, "x", "y", raster).collect()}
    assert got == {(0.5, 0.5): 5.5, (1.0, 1.0): 11.0, (2.5, 0.0): None}


def test_greedy_matching_is_the_sequential_one(spark):
    rng = random.Random(5)
    for n in (2, 5, 31):
        edges = [(rng.randrange(n), rng.randrange(n), float(rng.randrange(6))) for _ in range(4 * n)]
        got = {(r["a"], r["b"]) for r in graph.greedy_matching(spark.createDataFrame(edges, "a long, b long, c double"), "a", "b", "c").collect()}
        free, want = set(range(n)), set()
        for _, a, b in sorted((c, min(a, b), max(a, b)) for a, b, c in edges if a != b):
            if {a, b} <= free:
                free -= {a, b}
                want.add((a, b))
        assert got == want


def test_split_tree(spark):
    rng = random.Random(6)
    rows = [(i, rng.random() * 100, rng.random(), 5.0) for i in range(500)] + [(1000 + i, 7.0, 0.5, 5.0) for i in range(100)]
    got = points.split_tree(spark.createDataFrame(rows, "id long, x double, y double, z double"), "id", ["x", "y", "z"], 40).collect()
    assert len(got) == len(rows)
    leaves = {}
    for r in got:
        leaves.setdefault(r["node"], []).append(r["id"])
    assert max(map(len, leaves.values())) <= 40
    assert not any(a != b and b.startswith(a) for a in leaves for b in leaves)


def test_similarity_fit(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(20):
        x, y, z = (rng.random() for _ in range(3))
        rows.append((x, y, z, -2 * y + 1, 2 * x + 2, 2 * z + 3))
    fit = points.similarity_fit(spark.createDataFrame(rows, "x double, y double, z double, u double, v double, w double"), ["x", "y", "z"], ["u", "v", "w"])
    assert math.isclose(fit["scale"], 2, rel_tol=1e-9) and fit["rmse"] < 1e-6
    assert [round(t, 6) for t in fit["translation"]] == [1, 2, 3]


def test_structural_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    a = rng.random((12, 9)) * 50
    b = a + rng.random((12, 9)) * 5
    frame = lambda m: spark.createDataFrame([(r, c, float(m[r, c])) for r in range(12) for c in range(9)], "row long, col long, v double")

    def blur(m):
        out = np.zeros_like(m)
        for r in range(12):
            for c in range(9):
                w = {(i, j): math.exp(-((i - r) ** 2 + (j - c) ** 2) / 4.5) for i in range(12) for j in range(9) if abs(i - r) <= 5 and abs(j - c) <= 5}
                out[r, c] = sum(m[k] * v for k, v in w.items()) / sum(w.values())
        return out

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    want = (((2 * ma * mb + 0.25) * (2 * cov + 2.25)) / ((ma**2 + mb**2 + 0.25) * (va + vb + 2.25))).mean()
    got = raster.structural_similarity(frame(a), frame(b), 50.0).first()
    assert math.isclose(got["ssim"], want, rel_tol=1e-9)
    assert math.isclose(got["psnr"], 10 * math.log10(2500 / ((a - b) ** 2).mean()), rel_tol=1e-9)
    same = raster.structural_similarity(frame(a), frame(a), 50.0).first()
    assert math.isclose(same["ssim"], 1.0) and same["psnr"] is None


def test_quantiles_of_frequent_values(spark, monkeypatch):
    """Nine of ten values are equal, keys are null, some have no finite value; no task gets a value's rows."""
    import numpy as np
    from pyspark.sql import functions as F

    from plumbline.operators import statistics

    ranked = []
    plain = statistics.running_sums

    def watched(df, *rest):
        ranked.append(df.count())
        return plain(df, *rest)

    monkeypatch.setattr(statistics, "running_sums", watched)
    rng = np.random.default_rng(4)
    rows = [(i % 3 if i % 3 else None, 5.0 if rng.random() < 0.9 else float(rng.integers(0, 200))) for i in range(20_000)]
    rows += [(7, float("nan")), (7, None), (8, float("inf")), (9, 1.5), (10, -0.0), (10, 0.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    wanted = {"q": ("linear", 0.37), "near": ("nearest", 0.95), "low": ("floor", 0.02), "top": ("linear", 1.0)}
    found = {r["k"]: r for r in statistics.quantiles(df, ["k"], F.col("v"), wanted).collect()}
    assert ranked[0] < 1000
    for k in {k for k, _ in rows}:
        v = np.sort([x for q, x in rows if q == k and x is not None and np.isfinite(x)])
        if not len(v):
            assert found[k]["q"] is None and found[k]["near"] is None
            continue
        assert found[k]["q"] == pytest.approx(np.quantile(v, 0.37))
        assert found[k]["near"] == v[max(0, int(np.ceil(len(v) * 0.95)) - 1)]
        assert found[k]["low"] == v[int(np.floor((len(v) - 1) * 0.02))]
        assert found[k]["top"] == v[-1]
    every = statistics.quantiles(df, [], F.col("v"), wanted).first()
    assert every["q"] == 5.0 and every["top"] == 199.0
