import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import control_points as cp
from plumbline.sources import point_tables as pt


def _ply(path, n, extra=b""):
    kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f8"), ("opacity", "<f4")])
    rows = np.zeros(n, kind)
    rows["x"], rows["z"] = np.arange(n), np.arange(n) * 0.5
    path.write_bytes(pt.ply_header([("x", "float"), ("y", "float"), ("z", "double"), ("opacity", "float")], n) + rows.tobytes() + extra)


def test_ply_is_read_in_ranges(spark, tmp_path):
    _ply(tmp_path / "a.ply", 1000)
    _ply(tmp_path / "b.ply", 0)
    df = pt.read_points(spark, str(tmp_path), rangeBytes="4000")
    assert df.rdd.getNumPartitions() == 5
    row = df.agg(F.count("*"), F.sum("x"), F.sum("z"), F.countDistinct("source_id"), F.max(F.abs(F.col("source_id") - F.col("x")))).first()
    assert tuple(row) == (1000, 499_500.0, 249_750.0, 1000, 0.0)
    assert pt.vertex_count(str(tmp_path / "a.ply")) == 1000


def test_ply_of_a_wrong_size_is_an_error(tmp_path):
    _ply(tmp_path / "c.ply", 3, b"x")
    with pytest.raises(ValueError):
        pt.read_layout(str(tmp_path / "c.ply"))


def test_control_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Label;Easting;Northing;Altitude;Role\nP1;1.5;2;3;checkpoint\nP2; 4 ;x;;\n")
    got = [tuple(r)[1:] for r in cp.read_delimited(spark, str(tmp_path / "a.csv")).orderBy("external_id").collect()]
    assert got == [("P1", 1.5, 2.0, 3.0, "checkpoint", 0.02, 0.03, 1.0, None), ("P2", 4.0, None, 0.0, "adjustment", 0.02, 0.03, 1.0, "coordinate")]
    (tmp_path / "b.csv").write_text("pointid,easting,northing,elevation,sigma_xy,usage\nQ1,1,2,,0.5,check\n,1,2,3,,\nQ2,1,2,3,-1,\nQ3,1,2,3,,other\n")
    got = {r["external_id"]: r for r in cp.read_delimited(spark, str(tmp_path / "b.csv"), profile="leica").collect()}
    assert (got["Q1"]["z"], got["Q1"]["role"], got["Q1"]["horizontal_accuracy_m"], got["Q1"]["problem"]) == (0.0, "checkpoint", 0.5, None)
    assert (got[None]["problem"], got["Q2"]["problem"], got["Q3"]["problem"]) == ("no id", "accuracy", "role")
    (tmp_path / "c.csv").write_text("R1\t1\t2\t3\nR2\t4\t5\t6\n")
    found = cp.read_delimited(spark, str(tmp_path / "c.csv"), header=["punkt", "x", "y", "z"], named={"external_id": "Punkt"})
    assert sorted((r["external_id"], r["z"]) for r in found.collect()) == [("R1", 3.0), ("R2", 6.0)]
    (tmp_path / "two").mkdir()
    for name, crs in (("g1", "EPSG:32631"), ("g2", "EPSG:2154")):
        (tmp_path / "two" / f"{name}.txt").write_text(f"{crs}\n1 2 3 10 20 a.jpg P1\n")
    two = cp.read_observations(spark, str(tmp_path / "two")).collect()
    assert sorted((r["crs"], len(r["observations"])) for r in two) == [("EPSG:2154", 1), ("EPSG:32631", 1)]
    (tmp_path / "p.txt").write_text("# comment\nimg one.jpg 1 2 3\nb.jpg 4 5 6 # more\nb.jpg 7 8 9\n")
    got = {(r["name"], r["x"], r["duplicate"]) for r in cp.read_positions(spark, str(tmp_path / "p.txt")).collect()}
    assert got == {("img one.jpg", 1.0, False), ("b.jpg", 4.0, True), ("b.jpg", 7.0, True)}
    (tmp_path / "g.txt").write_text("EPSG:32631\n1 2 3 10 20 a.jpg P1\n1 2 3 11 21 b.jpg P1\n4 5 6 1 1 a.jpg\n")
    got = {r["external_id"]: [o["image"] for o in r["observations"]] for r in cp.read_observations(spark, str(tmp_path / "g.txt")).collect()}
    assert got == {"P1": ["a.jpg", "b.jpg"], "4 5 6": ["a.jpg"]}


def test_event_marks(spark, tmp_path):
    line = "{}\t{}\t[2200]\t  -1,N\t  2,E\t  3,V\t48.5,Lat\t2.25,Lon\t101.5,Ellh\t0.01, 0.02, 0.03\t50,Q"
    (tmp_path / "a.MRK").write_text("\n".join([line.format(1, 10.5), line.format(2, 11), "x\ty", line.format(2, 12.5), "3\t1\t[2]\ta\tb\tc\td\te\tf"]))
    got = {r["event"]: r for r in cp.read_event_marks(spark, str(tmp_path / "a.MRK")).collect()}
    assert set(got) == {1, 2} and got[2]["gps_second"] == 12.5 and got[1]["gps_week"] == 2200
    assert (got[1]["latitude"], got[1]["longitude"], got[1]["altitude_m"], got[1]["deviations_m"]) == (48.5, 2.25, 101.5, [0.01, 0.02, 0.03])


def test_geojson_round_trip(spark, tmp_path):
    features = spark.createDataFrame([(1, '{"type":"Point","coordinates":[1.0,2.0]}', "a"), (2, None, "b")], "id long, g string, name string")
    cp.write_geojson_lines(features, str(tmp_path / "out"), F.col("g"), ["id", "name"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 1
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[' + ",".join(lines) + "]}")
    row = cp.read_geojson(spark, str(tmp_path / "f.json")).first()
    assert (row["kind"], row["coordinates"], row["properties"]) == ("Point", "[1.0,2.0]", '{"id":1,"name":"a"}')


def test_publish_changed(spark):
    new = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    known = new.where("path = 'a'").withColumn("sha256", F.sha2("content", 256))
    assert [r["path"] for r in cp.publish_changed(new, known).collect()] == ["b"]


def test_reconstruction_files(spark, tmp_path):
    import struct

    from plumbline.sources import reconstructions as rc

    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 7, 1, 640, 480, 500, 501, 320, 240))
    image = struct.pack("<i7di", 3, 1, 0, 0, 0, 4, 5, 6, 7) + b"a b.jpg\0" + struct.pack("<Q", 2) + struct.pack("<ddq", 1.5, 2.5, 9) + struct.pack("<ddq", 50, 60, -1)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + image)
    point = struct.pack("<Q3d3BdQ", 9, 1, 2, 3, 10, 20, 30, 0.5, 2) + struct.pack("<iiii", 3, 0, 3, 1)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + point)
    camera = rc.read_cameras(spark, str(tmp_path / "cameras.bin")).first()
    assert (camera["camera_id"], camera["width"], camera["params"]) == (7, 640, [500, 501, 320, 240])
    images, points = rc.read_images(spark, str(tmp_path / "images.bin")), rc.read_points3d(spark, str(tmp_path / "points3D.bin"))
    assert images.first()["name"] == "a b.jpg" and images.first()["points"][1]["point3d_id"] == -1
    assert rc.good_points(points, 0.5, 2).count() == 1 and rc.good_points(points, 0.4, 2).count() == 0
    crops = spark.createDataFrame([(3, 0.0, 0.0, 10.0, 10.0)], "image_id int, x0 double, y0 double, x1 double, y1 double")
    kept = rc.tracks_in_crops(points, images, crops).first()
    assert [tuple(o) for o in kept["track"]] == [(3, 0)]


def test_kml(spark, tmp_path):
    from plumbline.sources import reconstructions as rc

    (tmp_path / "a.kml").write_text("<kml><Document><Placemark><name>P</name><Point><coordinates> 1.5,2.5,3 </coordinates></Point></Placemark><Placemark><name>L</name></Placemark></Document></kml>")
    assert [tuple(r) for r in rc.read_kml(spark, str(tmp_path / "a.kml")).collect()] == [("P", 1.5, 2.5, 3.0)]
