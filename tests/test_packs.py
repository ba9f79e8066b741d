"""Packs and PLY files written by several tasks and read back."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import trees
from plumbline.sources import packs, point_tables

FIELDS = [("x", "u2"), ("y", "u2"), ("s", "i1"), ("t", "i2"), ("id", "i8")]


def _points(spark, n=2000):
    return spark.range(n).select(
        (F.col("id") % 7).cast("string").alias("pack"), (F.sin("id") * 50 + 5e6).alias("x"), (F.cos("id") * 3).alias("y"), (F.sin(F.col("id") * 3) * 2).alias("s"), (F.col("id") % 11 - 5.0).alias("t"), "id"
    )


def _write(df, path, mode="append"):
    made = packs.quantised_packs(df, "pack", ["x", "y"], {"s": 8, "t": 16})
    packs.write_packs(made, path, "pack", ["id"], FIELDS, ["x_low", "x_high", "y_low", "y_high", "s_scale", "t_scale"], mode)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    df = _points(spark).repartition(5)
    _write(df, path)
    found = packs.restored(packs.read_packs(spark, path), ["x", "y"], ["s", "t"])
    assert found.columns == ["pack", "place", "x", "y", "s", "t", "id"]
    rows = {r["id"]: r for r in found.collect()}
    want = {r["id"]: r for r in df.collect()}
    assert rows.keys() == want.keys()
    for i, w in want.items():
        r = rows[i]
        assert r["pack"] == w["pack"] and r["place"] == i // 7
        assert abs(r["x"] - w["x"]) <= 100 / 65535 and abs(r["y"] - w["y"]) <= 6 / 65535 and abs(r["s"] - w["s"]) <= 2 / 127 and abs(r["t"] - w["t"]) <= 5 / 32767
    manifest = json.loads((tmp_path / "p" / "manifest.json").read_text())
    assert [p["id"] for p in manifest["packs"]] == [str(i) for i in range(7)]
    for p in manifest["packs"]:
        data = (tmp_path / "p" / p["path"]).read_bytes()
        assert len(data) == p["bytes"] == 32 + 15 * p["records"] and zlib.crc32(data[32:]) == p["crc32"]
        assert struct.unpack_from("<4sHHHHI", data) == (b"PLPK", 1, 32, 15, 0, p["records"])
    # What was written is a sound set of packs for the tree's check.
    table = spark.createDataFrame([("t", p["id"], p["path"], 32, p["bytes"], p["records"], "0" * 64) for p in manifest["packs"]], "tree string, pack string, path string, offset long, length long, records long, sha256 string")
    box = "struct<min:array<double>,max:array<double>>"
    tile = "struct<pack:string,offset:long,length:long,records:long,sha256:string>"
    node = [("t", "r", None, ([0.0] * 3, [1.0] * 3), ([0.0] * 3, [1.0] * 3), 0.0, p["records"], (p["id"], 32, p["bytes"] - 32, p["records"], "0" * 64), None) for p in manifest["packs"][:1]]
    nodes = spark.createDataFrame(node, f"tree string, node string, children array<string>, box {box}, support {box}, error double, records long, tile {tile}, merged {tile}")
    roots = spark.createDataFrame([("t", "r", manifest["packs"][0]["records"])], "tree string, root string, records long")
    assert trees.tree_violations(roots, nodes, table.where("pack = '0'"), record=15).count() == 0


def test_append_overwrite_and_damage(spark, tmp_path):
    path = str(tmp_path / "p")
    df = _points(spark, 300)
    _write(df.where("pack < '3'"), path)
    _write(df.where("pack >= '3'"), path)
    assert packs.read_packs(spark, path).count() == 300
    with pytest.raises(Exception, match="packs of that name"):
        _write(df.where("pack = '1'"), path)
    assert packs.read_packs(spark, path).count() == 300
    _write(df.where("pack = '1'"), path, "overwrite")
    assert packs.read_packs(spark, path).count() == df.where("pack = '1'").count()
    assert len(list((tmp_path / "p").glob("*.bin"))) == 1
    file = next((tmp_path / "p").glob("*.bin"))
    data = bytearray(file.read_bytes())
    data[-1] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        packs.read_packs(spark, path).count()
    kind = np.dtype([("a", "<u2")])
    good = packs.encoded_pack("n", np.array([(1,), (2,)], kind))
    assert packs.decoded_pack("n", good, kind)["a"].tolist() == [1, 2]
    for bad in (good[:20], good[:-1], b"XXXX" + good[4:]):
        with pytest.raises(ValueError):
            packs.decoded_pack("n", bad, kind)
    for wrong in (np.zeros(0, kind), np.zeros(packs.MOST_BYTES // 2, kind)):
        with pytest.raises(ValueError):
            packs.encoded_pack("n", wrong)


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "p"
    df = _points(spark, 300).withColumn("t", F.when(F.col("id") == 299, F.raise_error(F.lit("lost"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="lost"):
        packs.write_packs(df.select("pack", F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(1).alias("s"), F.col("t").cast("int").alias("t"), "id"), str(path), "pack", ["id"], FIELDS)
    assert not (path / "manifest.json").exists()
    with pytest.raises(Exception, match="null"):
        packs.write_packs(_points(spark, 9).select("pack", *[F.lit(None).cast("int").alias(c) for c in "xyst"], "id"), str(path), "pack", ["id"], FIELDS)
    assert not (path / "manifest.json").exists() and not list(path.glob("*.bin"))
    with pytest.raises(Exception, match="several tasks"):
        spark.dataSource.register(packs.PackDataSource)
        one = spark.range(40).select(F.lit("a").alias("pack"), F.col("id").cast("int").alias("v")).repartition(4)
        one.write.format("packs").mode("append").option("fields", '[["v", "i4"]]').option("pack", "pack").save(str(path))
    assert not (path / "manifest.json").exists() and not list(path.glob("*.bin"))


def test_one_ply_file(spark, tmp_path):
    path = str(tmp_path / "all.ply")
    df = spark.range(1000).select(F.col("id").cast("float").alias("x"), F.lit(1.0).cast("float").alias("y"), F.lit(2.0).cast("float").alias("z"), (F.col("id") / 3).alias("v")).repartition(6)
    packs.write_ply(df, path)
    back = point_tables.read_points(spark, path, rangeBytes="3000")
    assert sorted((r["x"], r["v"]) for r in back.collect()) == [(float(i), i / 3) for i in range(1000)]
    assert sorted(r["source_id"] for r in back.collect()) == list(range(1000))
    packs.write_ply(df.limit(0), str(tmp_path / "none.ply"))
    assert point_tables.vertex_count(str(tmp_path / "none.ply")) == 0
    with pytest.raises(ValueError):
        packs.write_ply(df.select("v", "x"), path)
    with pytest.raises(Exception, match="lost"):
        packs.write_ply(df.withColumn("v", F.when(F.col("x") == 500, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), str(tmp_path / "bad.ply"))
    assert not list(tmp_path.glob("bad.ply*"))
