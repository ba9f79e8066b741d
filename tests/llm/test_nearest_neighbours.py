import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import nearest_neighbours as nn
from plumbline.llm.queries import op8_nearest_neighbours


def _brute(ids, x, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(np.square(x - x[i]).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def _rows(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 4)), 3).astype(np.float32)
    x[100:200] = x[0]  # a large group of copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    rows += [(1000, None), (1100, []), (1200, [0.0] * 4), (1300, [1.0, None, 0.0, 0.0]), (1400, [1.0, float("nan"), 0.0, 0.0]), (1500, [1.0] * 3), (None, [1.0] * 4), (0, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS leaf").repartition(5)
    got = _rows(nn.search(vectors, F.col("vec_id") % 50 == 0, k=10, recall=1.0))
    want = _brute(list(range(400)), x.astype(float), range(0, 400, 50), 10)
    assert got.keys() == want.keys()
    assert got == want


def test_few_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert _rows(nn.search(vectors, F.col("vec_id") == 0)) == {0: [(1, 2**0.5)]}
    assert nn.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    assert nn.search(vectors.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def _recall(spark, x):
    ids = list(range(len(x)))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    want, got = _brute(ids, x, range(0, len(x), 20), 10), _rows(nn.search(vectors, F.col("vec_id") % 20 == 0, k=10))
    assert all(len(got[q]) == 10 for q in want)
    return sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / (10 * len(want))


def test_recall_on_clustered_and_skewed_vectors(spark):
    """Clusters of three to thousands of vectors, tight and wide; whole results wherever a query stands."""
    rng = np.random.default_rng(7)
    sizes = [2500, 900, 300, 100, 40, 12, 5, 3, *[8] * 30]
    x = np.concatenate([rng.normal(size=16) * 9 + rng.normal(size=(n, 16)) * rng.choice([0.01, 0.3, 1.5]) for n in sizes])
    assert _recall(spark, x[rng.permutation(len(x))]) >= 0.9
    assert _recall(spark, np.exp(rng.normal(size=(2200, 8)) * 2)) >= 0.9


def test_calibration_asks_what_the_tree_has_not_seen(spark, monkeypatch):
    seen = {}
    build, calibrate = nn.build_tree, nn._calibrate
    monkeypatch.setattr(nn, "build_tree", lambda points, *a: seen.setdefault("tree", points) is None or build(points, *a))
    monkeypatch.setattr(nn, "_calibrate", lambda tree, c, ids, queries, *a: seen.setdefault("asked", queries) is None or calibrate(tree, c, ids, queries, *a))
    x = np.random.default_rng(3).normal(size=(1500, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert nn.search(vectors, F.col("vec_id") < 3, sample=800).count() == 30
    assert len(seen["tree"]) > 500 and len(seen["asked"]) == nn.CALIBRATION
    assert not {tuple(v) for v in seen["tree"]} & {tuple(v) for v in seen["asked"]}


def test_one_id_with_different_vectors(spark):
    """Thirty vectors share the query's id: none of them is its neighbour, and its result is whole all the same."""
    rows = [(0, [1.0, i / 1000]) for i in range(30)] + [(i, [float(i), 5.0]) for i in range(1, 400)] + [(7, [-40.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nn.search(vectors, F.col("vec_id").isin(0, 7), k=10, recall=0.2).collect()
    of_7 = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 7)
    assert len(got) == 320 and len(of_7) == 20 and all(v != 7 for _, v in of_7)
    assert {r["vec_id"] for r in got if r["query_id"] == 0} == set(range(1, 11))


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].tolist()
    queries = [i for i in ids if i % 100 == 0]
    want, got = _brute(ids, x, queries, 10), _rows(op8_nearest_neighbours(spark, sf))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in queries)
    assert hits / (10 * len(queries)) >= 0.9
    assert all(len(got[q]) == 10 for q in queries)
    exact = {(q, v): d for q in queries for v, d in zip(ids, np.sqrt(np.square(x - x[ids.index(q)]).sum(axis=1)), strict=True)}
    assert all(exact[q, v] == d for q, found in got.items() for v, d in found)


def test_lengths_and_blocks_of_queries(spark, monkeypatch):
    """Each length is searched by itself; queries of a leaf meet its points in blocks, all of them."""
    monkeypatch.setattr(nn, "QUERY_BLOCK", 3)
    monkeypatch.setattr(nn, "CHUNK", 20)
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for first, n, dimension in ((0, 300, 5), (1000, 60, 3), (2000, 4, 2)):
        x = rng.normal(size=(n, dimension))
        ids = list(range(first, first + n))
        rows += [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
        want |= _brute(ids, x, [i for i in ids if i % 2 == 0], 6)
    vectors = spark.createDataFrame([*rows, (5001, [1.0])], "vec_id long, embedding array<double>").repartition(4)
    got = _rows(nn.search(vectors, F.col("vec_id") % 2 == 0, k=6, recall=1.0))
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [v for v, _ in got[q]] == [v for v, _ in near] and np.allclose([d for _, d in got[q]], [d for _, d in near])
