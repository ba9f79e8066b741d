"""GeoJSON geometries as text: their positions, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least positions of each type of geometry (fixed values).
LEAST = {"Point": 1, "MultiPoint": 1, "LineString": 2, "MultiLineString": 2, "Polygon": 4, "MultiPolygon": 4}
MOST = 50_000
#: Arrays inside arrays, at most; GeoJSON itself has four.
DEPTH = 8

_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
#: An array that begins with two numbers and holds no other array.
_POSITION = rf"\[({_NUMBER}),({_NUMBER})(?:,[^\[\]]*)?\]"


def _compact(coordinates: Column) -> Column:
    return F.regexp_replace(coordinates, r"\s", "")


def flat_coordinates(coordinates: Column) -> Column:
    """All positions of a JSON array of coordinates, nested to any depth, as (x, y) in their order."""
    text = _compact(coordinates)
    x, y = F.regexp_extract_all(text, F.lit(_POSITION), 1), F.regexp_extract_all(text, F.lit(_POSITION), 2)
    return F.zip_with(x, y, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")))


def _is_nested(coordinates: Column) -> Column:
    """Whether positions are put together by arrays alone: they are folded from the inside, one depth after another."""
    text = F.regexp_replace(_compact(coordinates), _POSITION, "p")
    for _ in range(DEPTH - 1):
        text = F.regexp_replace(text, r"\[(?:p(?:,p)*)?\]", "p")
    return text == "p"


def geometry_problem(geometry: Column) -> Column:
    """What is wrong with a GeoJSON geometry, or null: object, type, structure, range, few, many.

    Longitudes are within 180 degrees, latitudes within 90; there are as many positions as the type needs, 50,000 at most,
    whatever arrays they are nested in. A null text is no object.
    """
    kind, coordinates = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    points = flat_coordinates(coordinates)
    inside = F.forall(points, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90))
    least = F.create_map(*[F.lit(v) for pair in LEAST.items() for v in pair])[kind]
    return (
        F.when(F.coalesce(F.json_object_keys(geometry).isNull(), F.lit(True)), "object")
        .when(~F.coalesce(kind.isin(*LEAST), F.lit(False)), "type")
        .when(~F.coalesce(_is_nested(coordinates), F.lit(False)), "structure")
        .when(F.size(points) > MOST, "many")
        .when(~inside, "range")
        .when(F.size(points) < least, "few")
    )
