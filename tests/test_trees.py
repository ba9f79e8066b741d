"""Trees of tiles: violations against a walk from the root, cuts against a recursion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.cameras import Camera, seen
from plumbline.operators import trees

TILE = "struct<pack:string,offset:long,length:long,records:long,sha256:string>"
BOX = "struct<min:array<double>,max:array<double>>"
NODES = f"tree string, node string, children array<string>, box {BOX}, support {BOX}, error double, records long, tile {TILE}, merged {TILE}"
PACKS = "tree string, pack string, path string, offset long, length long, records long, sha256 string"
HASH = "c" * 64


def _box(r):
    return [-r] * 3, [r] * 3


def _tile(offset, records=1, pack="p", sha=HASH):
    return pack, 32 + 96 * offset, 96 * records, records, sha


def _node(name, children=None, at=0, of=1, r=1.0, tree="t", merged=1):
    tile, proxy = (None, _tile(at, merged)) if children else (_tile(at, of), None)
    return [tree, name, children, _box(r), _box(2 * r), 1.0, of, tile, proxy]


def _pack(records, name="p", path="packs/p.bin", tree="t"):
    return [tree, name, path, 32, 32 + 96 * records, records, HASH]


def _found(spark, nodes, packs, root="r", records=None, tree="t"):
    records = sum(n[6] for n in nodes if n[7]) if records is None else records
    rows = trees.tree_violations(
        spark.createDataFrame([(tree, root, records)], "tree string, root string, records long"), spark.createDataFrame(nodes, NODES), spark.createDataFrame(packs, PACKS)
    ).collect()
    return sorted((r["kind"], r["id"]) for r in rows)


def _binary():
    return [_node("r", ["a", "b"], at=0, of=2), _node("a", at=1), _node("b", at=2)]


def test_sound_trees(spark):
    assert _found(spark, _binary(), [_pack(3)]) == []
    assert _found(spark, [_node("r")], [_pack(1)]) == []
    most = (trees.MOST_PACK_BYTES - 32) // 96
    assert _found(spark, [_node("r", of=most)], [_pack(most)]) == []


@pytest.mark.parametrize("change,want", [
    (lambda n, p: n.__setitem__(0, _node("r", ["a"], of=2)), {("child_count", "r"), ("unreachable", "b")}),
    (lambda n, p: (n.__setitem__(0, _node("r", ["a", "b", "c"], of=3)), n.append(_node("c", at=3)), p.__setitem__(0, _pack(4))), {("child_count", "r")}),
    (lambda n, p: p.__setitem__(0, _pack(3, path="../p.bin")), {("path", "p")}),
    (lambda n, p: p.__setitem__(0, _pack(3, path="/p.bin")), {("path", "p")}),
    (lambda n, p: p.__setitem__(0, _pack(3, path=None)), {("path", "p")}),
    (lambda n, p: n.append(_node("a", at=3)) or p.__setitem__(0, _pack(4)), {("duplicate_node", "a")}),
    (lambda n, p: n.__setitem__(0, _node("r", ["a", "z"], of=2)), {("unknown_child", "z"), ("unreachable", "b")}),
    (lambda n, p: n.__setitem__(0, _node("r", ["a", "a"], of=2)), {("shared_child", "a"), ("unreachable", "b")}),
    (lambda n, p: n.__setitem__(0, _node("r", ["a", "r"], of=2)), {("unreachable", "b")}),
    (lambda n, p: n[1].__setitem__(4, _box(9.0)), {("parent_misses_child", "a")}),
    (lambda n, p: n[1].__setitem__(4, _box(0.5)), {("support_misses_box", "a")}),
    (lambda n, p: n[1].__setitem__(3, ([1.0, 1.0, math.nan], [2.0, 2.0, 2.0])), {("box", "a")}),
    (lambda n, p: n[1].__setitem__(3, ([1.0, 1.0, 3.0], [2.0, 2.0, 2.0])), {("box", "a")}),
    (lambda n, p: n[1].__setitem__(3, None), {("box", "a")}),
    (lambda n, p: n[1].__setitem__(5, -1.0), {("error", "a")}),
    (lambda n, p: n[1].__setitem__(5, None), {("error", "a")}),
    (lambda n, p: n[1].__setitem__(7, _tile(1, 1, "q")), {("unknown_pack", "a"), ("gap", "p")}),
    (lambda n, p: n[1].__setitem__(7, _tile(1, 1, sha="d" * 64)), {("tile_range", "a")}),
    (lambda n, p: n[1].__setitem__(7, _tile(2)), {("gap", "p"), ("overlap", "p")}),
    (lambda n, p: n[0].__setitem__(8, _tile(0, 3)), {("merged_records", "r"), ("overlap", "p")}),
    (lambda n, p: n[1].__setitem__(8, _tile(1)), {("no_merged_tile", "a"), ("overlap", "p")}),
    (lambda n, p: n[1].__setitem__(7, None), {("children_or_tile", "a"), ("gap", "p")}),
    (lambda n, p: p[0].__setitem__(4, 32 + 96 * 4), {("pack_length", "p"), ("gap", "p")}),
    (lambda n, p: p[0].__setitem__(6, "C" * 64), {("pack_hash", "p"), ("tile_range", "a"), ("tile_range", "b"), ("tile_range", "r")}),
    (lambda n, p: p.append(_pack(1, "unused", "u")), {("unused_pack", "unused"), ("gap", "unused")}),
])
def test_each_violation(spark, change, want):
    nodes, packs = _binary(), [_pack(3)]
    change(nodes, packs)
    assert set(_found(spark, nodes, packs, records=sum(n[7][3] for n in nodes if n[7]))) == want


def test_population_root_and_size(spark):
    assert _found(spark, _binary(), [_pack(3)], records=5) == [("population", None)]
    assert ("unknown_root", "q") in _found(spark, _binary(), [_pack(3)], root="q")
    most = (trees.MOST_PACK_BYTES - 32) // 96 + 1
    assert _found(spark, [_node("r", of=most)], [_pack(most)]) == [("pack_length", "p")]
    assert _found(spark, [], [], records=0) == [("unknown_root", "r")]


def test_reachability_with_cycles(spark):
    rng = random.Random(3)
    for _ in range(3):
        parents = {i: rng.choice([i // 2, i // 2, i // 2, rng.randrange(1, 60), i - 1 or 1]) for i in range(2, 60)}
        good = set()
        for i in range(1, 60):
            way, at = set(), i
            while at != 1 and at not in way:
                way.add(at)
                at = parents[at]
            if at == 1:
                good.add(i)
        root = spark.createDataFrame([("t", 1)], "tree string, root long")
        nodes = spark.createDataFrame([("t", i) for i in range(1, 60)], "tree string, node long")
        edges = spark.createDataFrame([("t", p, i) for i, p in parents.items()], "tree string, parent long, node long")
        assert {r["node"] for r in trees.unreached(root, nodes, edges).collect()} == set(range(1, 60)) - good


def _recursive_cut(nodes, budget, error, keep, fill):
    by = {n["node"]: n for n in nodes}
    kids = {}
    for n in nodes:
        kids.setdefault(n["parent"], []).append(n["node"])

    def cut(most):
        out, stack = [], [0]
        while stack:
            at = by[stack.pop()]
            if not at["visible"]:
                if keep:
                    out.append(at["node"])
                continue
            below = [c for c in kids.get(at["node"], []) if keep or by[c]["visible"]]
            if not at["leaf"] and not below:
                continue
            if below and at["error"] > most:
                stack.extend(below)
            else:
                out.append(at["node"])
        return out, sum(by[i]["records"] for i in out)

    chosen, limited = (cut(0.0), 0.0), False
    if chosen[0][1] > budget:
        limited = cut(error)[1] > budget
        steps = sorted({0.0} | {n["error"] for n in nodes if not n["leaf"] and n["visible"] and n["error"] > 0})
        low, high = 0, len(steps) - 1
        while low <= high:
            middle = (low + high) // 2
            found = cut(steps[middle])
            if found[1] <= budget:
                chosen, high = (found, steps[middle]), middle - 1
            else:
                low = middle + 1
    (shown, held), threshold = chosen
    if fill and all(by[i]["leaf"] for i in shown):
        beside = {c for i in shown if by[i]["parent"] is not None for c in kids[by[i]["parent"]] if by[c]["leaf"]} - set(shown)
        for c in sorted(beside):
            if held + by[c]["records"] <= budget:
                shown, held = [*shown, c], held + by[c]["records"]
    return sorted(shown), threshold, limited


@pytest.mark.parametrize("size,keep,fill,tight", [(5000, False, False, 8), (700, True, False, 5), (700, False, True, 1), (300, False, True, 3), (60, True, True, 2), (1, False, False, 1)])
def test_cut_against_recursion(spark, size, keep, fill, tight):
    rng = random.Random(size + tight)
    nodes = [{"node": i, "parent": rng.randrange(max(0, i - 40), i) if i else None, "visible": i == 0 or rng.random() < 0.85, "error": 0.0, "radius": 1.0, "records": rng.randint(1, 30)} for i in range(size)]
    inner = {n["parent"] for n in nodes}
    for n in nodes:
        n["leaf"] = n["node"] not in inner
        n["error"] = 0.0 if n["leaf"] or not n["visible"] else round(rng.random() * 50, 1)
    df = spark.createDataFrame(nodes, "node long, parent long, visible boolean, error double, radius double, records long, leaf boolean")
    budget = max(nodes[0]["records"], sum(n["records"] for n in nodes) // tight)
    found = trees.best_cut(df, budget, 12.0, keep, fill).collect()
    want, threshold, limited = _recursive_cut(nodes, budget, 12.0, keep, fill)
    assert sorted(r["node"] for r in found) == want
    assert sum(r["records"] for r in found) <= budget
    assert {(r["threshold"], r["limited"]) for r in found} <= {(threshold, limited)}


def test_cut_that_cannot_be_made(spark):
    schema = "node long, parent long, visible boolean, error double, radius double, records long, leaf boolean"
    one = lambda visible, records: spark.createDataFrame([(0, None, visible, 0.0, 1.0, records, True)], schema)
    with pytest.raises(ValueError, match="budget"):
        trees.best_cut(one(True, 9), 5, 1.0)
    assert trees.best_cut(one(False, 9), 5, 1.0).count() == 0
    assert trees.best_cut(one(False, 4), 5, 1.0, keep_unseen=True).count() == 1
    assert trees.best_cut(one(True, 4).limit(0), 5, 1.0).count() == 0


def test_refined_before(spark):
    nodes = spark.createDataFrame([(i, i // 2 if i > 1 else None) for i in range(1, 32)], "node long, parent long")
    shown = spark.createDataFrame([(19,), (5,)], "node long")
    assert {r["node"] for r in trees.refined_before(nodes, shown).collect()} == {9, 4, 2, 1}


def test_camera_sees_boxes(spark):
    camera = Camera((0.0, 0.0, 0.0), (0.0, 0.0, -1.0), (0.0, 1.0, 0.0), math.pi / 2, 200, 100)
    boxes = [(-1.0, -1.0, -11.0, 1.0, 1.0, -9.0), (-1.0, -1.0, 9.0, 1.0, 1.0, 11.0), (30.0, -1.0, -11.0, 31.0, 1.0, -9.0), (19.0, -1.0, -11.0, 31.0, 1.0, -9.0), (-1.0, 12.0, -11.0, 1.0, 13.0, -9.0), (-1.0, -1.0, -1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "a double, b double, c double, d double, e double, f double")
    rows = df.select(seen(camera, [F.col(c) for c in "abc"], [F.col(c) for c in "def"], F.lit(0.5), F.lit(True)).alias("s")).select("s.*").collect()
    assert [r["visible"] for r in rows] == [True, False, False, True, False, True]
    size = math.sqrt(3)
    assert rows[0]["radius"] == pytest.approx(size * 50 / (10 - size))
    assert rows[0]["error"] == pytest.approx(max(0.5 * 50 / 9, rows[0]["radius"] / 64))
    assert rows[5]["error"] == pytest.approx(50)
    with pytest.raises(ValueError):
        Camera((0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 1.0, 0.0), 1.0, 10, 10).planes()
