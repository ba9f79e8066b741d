import json
import struct

from pyspark.sql import functions as F

from plumbline.sources import imagery as im


def _jpeg(lat, lon, xmp=None):
    """A JPEG's header with EXIF (big-endian) and XMP; no image data."""
    data = b""

    def entry(tag, kind, n, value):
        return struct.pack(">HHI", tag, kind, n) + value

    def rationals(*x):
        return b"".join(struct.pack(">II", round(v * 1000), 1000) for v in x)

    def block(entries, heap, start):
        body = struct.pack(">H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        return body + heap, start + len(body)

    make = b"Maker\0"
    ifd0 = 8
    gps_at = ifd0 + 2 + 3 * 12 + 4 + len(make) + 20
    heap0 = ifd0 + 2 + 3 * 12 + 4
    when = b"2024:05:06 07:08:09\0"
    first, _ = block([entry(0x10F, 2, 6, struct.pack(">I", heap0)), entry(0x132, 2, 20, struct.pack(">I", heap0 + 6)), entry(0x8825, 4, 1, struct.pack(">I", gps_at))], make + when, ifd0)
    gps_heap = gps_at + 2 + 6 * 12 + 4
    d = lambda v: (abs(v) // 1, abs(v) % 1 * 60 // 1, abs(v) % 1 * 60 % 1 * 60)
    second, _ = block(
        [entry(1, 2, 2, (b"N" if lat >= 0 else b"S") + b"\0\0\0"), entry(2, 5, 3, struct.pack(">I", gps_heap)), entry(3, 2, 2, (b"E" if lon >= 0 else b"W") + b"\0\0\0"),
         entry(4, 5, 3, struct.pack(">I", gps_heap + 24)), entry(5, 1, 1, b"\0\0\0\0"), entry(6, 5, 1, struct.pack(">I", gps_heap + 48))],
        rationals(*d(lat)) + rationals(*d(lon)) + rationals(120.5), gps_at,
    )
    tiff = b"MM\0*" + struct.pack(">I", ifd0) + first + second
    for payload in [im.EXIF_START + tiff] + ([im.XMP_START + xmp.encode()] if xmp else []):
        data += b"\xff\xe1" + struct.pack(">H", len(payload) + 2) + payload
    return b"\xff\xd8" + data + b"\xff\xda"


def test_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    xmp = '<rdf:Description drone:GimbalYawDegree="+12.5" ><drone:RtkFlag> 50 </drone:RtkFlag></rdf:Description>'
    (tmp_path / "a.JPG").write_bytes(_jpeg(48.5, -2.25, xmp))
    (tmp_path / "sub" / "b.jpeg").write_bytes(b"\xff\xd8\xff\xe1\x00")
    (tmp_path / "sub" / "A.jpg").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in im.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.JPG", "b.jpeg", "A.jpg"}
    a = got["a.JPG"]
    assert (a["make"], a["captured_at"], a["alt"]) == ("Maker", "2024:05:06 07:08:09", 120.5) and abs(a["lat"] - 48.5) < 1e-6 and abs(a["lon"] + 2.25) < 1e-6
    assert got["b.jpeg"]["lat"] is None and got["A.jpg"]["xmp"] is None
    told = spark.createDataFrame([(a["xmp"],)], "xmp string").select(*[im.xmp_property(F.col("xmp"), n) for n in ("GimbalYawDegree", "RtkFlag", "Nothing")]).first()
    assert tuple(told) == ("+12.5", "50", None)
    files = {r["name"]: r["name_twice"] for r in im.discover(spark, str(tmp_path), ("jpg", "jpeg")).collect()}
    assert files == {"a.JPG": True, "A.jpg": True, "b.jpeg": False}
    assert [r["name"] for r in im.discover(spark, str(tmp_path), ("txt",)).collect()] == ["c.txt"]
    assert im.discover(spark, str(tmp_path), ("jpg", "jpeg"), prefixes=("sub",)).count() == 2


def test_strict_manifests(spark, tmp_path):
    texts = {"good": '{"id": "a", "n": 3}', "none": "[1]", "less": '{"id": "a"}', "more": '{"id": "a", "n": 1, "z": 0}', "twice": '{"id": "a", "n": 1, "n": 2}', "inside": '{"id": "a", "n": 1, "f": {"id": "x", "n": {"n": 2}}}', "again": '{"id": "{\\"n\\": 1}", "n": 1, "f": {}, "f": {}}', "type": '{"id": "a", "n": "x"}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["source_file"].rsplit("/", 1)[1][:-5]: r["problem"] for r in im.strict_manifests(spark, str(tmp_path), {"id": "string", "n": "long"}).collect()}
    nested = {r["source_file"].rsplit("/", 1)[1][:-5]: r["problem"] for r in im.strict_manifests(spark, str(tmp_path), {"id": "string", "n": "long", "f": "struct<id:string>"}).collect()}
    assert nested["inside"] is None and nested["again"] == "a field given twice" and nested["good"] == "missing: f"
    assert {k: v for k, v in got.items() if k not in ("inside", "again")} == {"good": None, "none": "no object", "less": "missing: n", "more": "unknown: z", "twice": "a field given twice", "type": "a value of another type"}


def test_markers_and_exports(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<document><markers><marker id="0" label="P1"><reference x="1.5" y="2.5" z="3"/></marker><marker id="1"><reference x="4" y="5"/></marker><marker id="2" label="no point"/></markers></document>')
    got = sorted((r["external_id"], r["x"], r["z"]) for r in im.read_markers(spark, str(tmp_path / "m.xml")).collect())
    assert got == [("1", 4.0, 0.0), ("P1", 1.5, 3.0)]
    at = spark.createDataFrame([("m", 2, 1.0, 5.0), ("m", 1, 0.0, 4.0), ("n", 1, 7.0, 8.0), ("n", 2, None, 8.0)], "m string, o int, lon double, lat double")
    lines = {r["m"]: json.loads(r["geometry"]) for r in im.flight_paths(at, "m", "o", "lon", "lat").collect()}
    assert lines == {"m": {"type": "LineString", "coordinates": [[0.0, 4.0], [1.0, 5.0]]}, "n": {"type": "Point", "coordinates": [7.0, 8.0]}}
    pairs = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("a", "c")], "a string, b string")
    im.write_pairs(pairs, "a", "b", str(tmp_path / "pairs"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "pairs")).orderBy("value").collect()] == ["a b", "a c"]
    assert spark.range(1).select(im.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})).first()[0] == '{"a":null,"b":1}'
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = im.file_manifest(im.discover(spark, str(tmp_path), ("bin",), content=True)).first()
    assert (row["length"], row["sha256"][:8]) == (3, "ba7816bf")
