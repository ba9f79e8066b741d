"""Survey control points and camera positions from text, CSV and GeoJSON, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which files give a column, in order of preference (fixed values).
ALIASES = {
    "external_id": ("point_id", "id", "label", "name", "marker", "gcp"),
    "x": ("x", "easting", "east", "longitude", "lon", "lng"),
    "y": ("y", "northing", "north", "latitude", "lat"),
    "z": ("z", "altitude", "elevation", "height", "alt"),
    "role": ("role", "usage", "type"),
    "horizontal_accuracy_m": ("horizontal_accuracy_m", "horizontal_accuracy", "accuracy_xy", "sigma_xy"),
    "vertical_accuracy_m": ("vertical_accuracy_m", "vertical_accuracy", "accuracy_z", "sigma_z"),
    "image_accuracy_px": ("image_accuracy_px", "accuracy_px", "sigma_px"),
}
#: What a column is called by some makers' files (fixed values).
PROFILES = {
    "leica": {"external_id": "pointid", "x": "easting", "y": "northing", "z": "elevation"},
    "trimble": {"external_id": "point name", "x": "easting", "y": "northing", "z": "elevation"},
}
#: Roles by the words that files use for them (fixed values).
ROLES = {
    "adjustment": ("adjustment", "adjust", "control", "gcp"),
    "checkpoint": ("checkpoint", "check", "validation", "verify"),
    "disabled": ("disabled", "ignore", "ignored", "off"),
}
ACCURACIES = ("horizontal_accuracy_m", "vertical_accuracy_m", "image_accuracy_px")


def resolve_aliases(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES, named: dict[str, str] | None = None) -> DataFrame:
    """For each column the first non-empty one among its aliases, whatever their case; a name given for it goes first."""
    by_name = {c.strip().lower(): c for c in df.columns}
    out = []
    for name, names in aliases.items():
        names = ((named or {}).get(name, "").strip().lower(), *names)
        found = [F.nullif(F.trim(F.col(f"`{by_name[a]}`").cast("string")), F.lit("")) for a in names if a in by_name]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def role_of(raw: Column, default: str = "adjustment") -> Column:
    """A role by any of its words, the default for none, null for a word of no role."""
    word = F.lower(F.trim(raw))
    known = F.when(word.isNull() | (word == ""), default)
    for role, words in ROLES.items():
        known = known.when(word.isin(*words), role)
    return known


def read_delimited(
    spark: SparkSession, path: str, separator: str | None = None, profile: str | None = None, named: dict[str, str] | None = None,
    header: list[str] | None = None, default_role: str = "adjustment", accuracies: tuple[float, float, float] = (0.02, 0.03, 1.0),
) -> DataFrame:
    """Points of delimited files: source_file, external_id, x, y, z (0 if empty), role, accuracies, and what is wrong with a row.

    Columns are found by aliases, by a maker's profile or by the names given for them; `header` names the columns
    of files without a header. The separator is the one that the first line has most of. An empty accuracy is the
    default; `problem` names a missing id, a coordinate or accuracy that is no finite (positive) number, or a role
    of no known word, and is null for good rows.
    """
    if separator is None:
        head = spark.read.text(path).limit(1).first()
        line = head[0] if head else ""
        separator = max(";,\t ", key=line.count)
    rows = spark.read.csv(path, header=header is None, sep=separator, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if header is not None:
        rows = rows.toDF(*header[: len(rows.columns)], *rows.columns[len(header) :])
    rows = rows.withColumn("__file", F.col("_metadata.file_path"))
    found = resolve_aliases(rows, {**ALIASES, "source_file": ("__file",)}, {**PROFILES.get(profile or "", {}), **(named or {})})
    number = lambda c: F.col(c).try_cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    z = F.when(F.col("z").isNull(), 0.0).otherwise(number("z"))
    measured = {c: F.when(F.col(c).isNull(), F.lit(float(d))).otherwise(number(c)) for c, d in zip(ACCURACIES, accuracies, strict=True)}
    role = role_of(F.col("role"), default_role)
    problem = (
        F.when(F.col("external_id").isNull(), "no id")
        .when(~(finite(number("x")) & finite(number("y")) & finite(z)), "coordinate")
        .when(~F.forall(F.array(*measured.values()), lambda v: finite(v) & (v > 0)), "accuracy")
        .when(role.isNull(), "role")
    )
    return found.select("source_file", "external_id", number("x").alias("x"), number("y").alias("y"), z.alias("z"), role.alias("role"), *[v.alias(c) for c, v in measured.items()], problem.alias("problem"))


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """`name x y z` lines: names may hold spaces, `#` starts a comment; `duplicate` marks names given twice."""
    pattern = r"^(.*\S)\s+(\S+)\s+(\S+)\s+(\S+)$"
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    lines = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.select(part(1).alias("name"), *[part(i + 2).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    twice = rows.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("duplicate"))
    return rows.join(twice, "name")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Control lists: each file a CRS line, then `x y z pixel_x pixel_y image [point]` lines; observations nested by file and point."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    crs = rows.where("i = 0").select(F.col("source_file").alias("__f"), F.trim("line").alias("crs"))
    field = F.split(F.trim("line"), r"\s+")
    one = rows.where("i > 0 AND trim(line) <> ''").select("source_file", "i", field.alias("f")).where(F.size("f") >= 6)
    number = lambda k: F.element_at("f", k).try_cast("double")
    shaped = one.select(
        "source_file", "i", *[number(k + 1).alias(c) for k, c in enumerate("xyz")],
        F.struct(F.col("i").alias("line"), F.element_at("f", 6).alias("image"), number(4).alias("pixel_x"), number(5).alias("pixel_y")).alias("o"),
        F.coalesce(F.try_element_at("f", F.lit(7)), F.concat_ws(" ", F.slice("f", 1, 3))).alias("external_id"),
    )
    points = shaped.groupBy("source_file", "external_id", "x", "y", "z").agg(F.array_sort(F.collect_list("o")).alias("observations"))
    return points.join(crs, F.col("source_file") == F.col("__f")).drop("__f")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollections: file, place in it, type and coordinates of the geometry as JSON, and properties as JSON."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    rows = text.select("source_file", F.posexplode(features).alias("position", "feature"))
    at = lambda p: F.get_json_object("feature", p)
    return rows.select("source_file", "position", at("$.geometry.type").alias("kind"), at("$.geometry.coordinates").alias("coordinates"), at("$.properties").alias("properties"))


def read_event_marks(spark: SparkSession, path: str) -> DataFrame:
    """Camera events of GNSS mark files: number, GPS week and second, position, its height and three deviations in metres.

    Fields are parted by tabs. The first three are number, second and [week]; `,Lat`, `,Lon` and `,Ellh` end the
    position's, and the field after the height holds the deviations. Lines without a number or a position go; of
    several marks of one number in a file the last one counts.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    fields = F.filter(F.transform(F.split("text", "	"), lambda f: F.trim(f)), lambda f: f != "")
    rows = lines.select("source_file", "line", fields.alias("f")).where(F.size("f") >= 9)

    def ending(mark: str) -> Column:
        hit = F.try_element_at(F.filter("f", lambda f: f.endswith(mark)), F.lit(1))
        return F.trim(F.regexp_replace(hit, f"{mark}$", "")).try_cast("double")

    height = F.array_position(F.transform("f", lambda f: f.endswith(",Ellh")), True).cast("int")
    after = F.transform(F.split(F.try_element_at("f", height + 1), ","), lambda x: F.trim(x).try_cast("double"))
    deviations = F.when((height > 0) & (F.size(after) >= 3) & F.forall(F.slice(after, 1, 3), lambda x: x.isNotNull()), F.slice(after, 1, 3))
    found = rows.select(
        "source_file", "line", F.element_at("f", 1).try_cast("long").alias("event"), F.element_at("f", 2).try_cast("double").alias("gps_second"),
        F.regexp_replace(F.element_at("f", 3), r"[\[\] ]", "").try_cast("long").alias("gps_week"),
        ending(",Lat").alias("latitude"), ending(",Lon").alias("longitude"), ending(",Ellh").alias("altitude_m"), deviations.alias("deviations_m"),
    )
    found = found.where("event IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    last = found.groupBy("source_file", "event").agg(F.max_by(F.struct("gps_second", "gps_week", "latitude", "longitude", "altitude_m", "deviations_m"), "line").alias("m"))
    return last.select("source_file", "event", "m.*")


def geojson_features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature as text for each row with a geometry (JSON text)."""
    shown = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), shown, F.lit("}"))
    return df.where(geometry.isNotNull()).select(feature.alias("value"))


def write_geojson_lines(df: DataFrame, path: str, geometry: Column, properties: list[str]) -> None:
    """Write newline-delimited features in parallel; Spark's commit makes the write atomic."""
    geojson_features(df, geometry, properties).write.text(path)


def publish_changed(new: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("path", "sha256")) -> DataFrame:
    """Files (path, content) whose content is not published yet, with its hash."""
    hashed = new.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(known.select(*keys).distinct(), list(keys), "left_anti")
