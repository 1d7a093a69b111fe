"""Drawn shapes: containment, bounds, areas. Rings are (lat, lon) corners."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, functions as F

RADIUS_M = 6_371_008.8


@dataclasses.dataclass(frozen=True)
class Shape:
    """kind 'polygon' (points), 'rectangle' (points: south-west and north-east corner) or 'circle' (points: the centre; radius in metres)."""

    kind: str
    points: tuple[tuple[float, float], ...]
    radius: float = 0.0


def bounds(s: Shape) -> tuple[float, float, float, float]:
    """South, west, north, east."""
    if s.kind == "circle":
        (lat, lon), d = s.points[0], math.degrees(s.radius / RADIUS_M)
        e = d / max(0.01, math.cos(math.radians(lat)))
        return lat - d, lon - e, lat + d, lon + e
    lats, lons = zip(*s.points)
    return min(lats), min(lons), max(lats), max(lons)


def haversine(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Metres on the sphere."""
    d_lat, d_lon = F.radians(b_lat - a_lat), F.radians(b_lon - a_lon)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.pow(F.sin(d_lon / 2), 2)
    return 2 * RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def contains(s: Shape, lat: Column, lon: Column) -> Column:
    """Whether a point lies in one given shape; its bounding box is tested first."""
    south, west, north, east = bounds(s)
    box = lat.between(south, north) & lon.between(west, east)
    if s.kind == "rectangle":
        return box
    if s.kind == "circle":
        return box & (haversine(F.lit(s.points[0][0]), F.lit(s.points[0][1]), lat, lon) <= s.radius)
    if len(s.points) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (lat_i, lon_i), (lat_j, lon_j) in zip(s.points, s.points[-1:] + s.points[:-1]):
        if lat_i != lat_j:
            at = (lon_j - lon_i) * (lat - lat_i) / (lat_j - lat_i) + lon_i
            crossings = crossings + F.when((F.lit(lat_i) > lat).__ne__(F.lit(lat_j) > lat) & (lon < at), 1).otherwise(0)
    return box & (crossings % 2 == 1)


def ring_contains(ring: Column, y: Column, x: Column, y_name: str = "lat", x_name: str = "lon") -> Column:
    """Even-odd rule for a column of rings (arrays of structs)."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        at = (b[x_name] - a[x_name]) * (y - a[y_name]) / F.nullif(b[y_name] - a[y_name], F.lit(0.0)) + a[x_name]
        return ((a[y_name] > y) != (b[y_name] > y)) & (x < at)

    return F.coalesce((n >= 3) & (F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), crosses)) % 2 == 1), F.lit(False))


def ring_area(ring: Column, y_name: str = "lat", x_name: str = "lon") -> Column:
    """Square metres inside a column of rings, on the sphere. The ring is made once a row, also where it is an expression."""

    def inside(ring: Column) -> Column:
        n = F.size(ring)

        def part(total: Column, i: Column) -> Column:
            a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
            return total + F.radians(b[x_name] - a[x_name]) * (2 + F.sin(F.radians(a[y_name])) + F.sin(F.radians(b[y_name])))

        return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), part) * RADIUS_M * RADIUS_M / 2)).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(ring), inside), 1)


def area(s: Shape) -> float:
    if s.kind == "circle":
        return math.pi * s.radius**2
    ring = s.points
    if s.kind == "rectangle":
        south, west, north, east = bounds(s)
        ring = ((south, west), (south, east), (north, east), (north, west))
    if len(ring) < 3:
        return 0.0
    total = sum(math.radians(b[1] - a[1]) * (2 + math.sin(math.radians(a[0])) + math.sin(math.radians(b[0]))) for a, b in zip(ring, ring[1:] + ring[:1]))
    return abs(total * RADIUS_M**2 / 2)


def area_label(s: Shape) -> str:
    miles = area(s) / 2_589_988.11
    if miles < 0.1:
        return f"{math.floor(area(s) / 4046.86 + 0.5)} acres"
    return f"{miles:.2f} sq mi" if miles < 10 else f"{miles:.1f} sq mi"


def label(s: Shape) -> str:
    return {"polygon": f"Polygon · {len(s.points)} points", "rectangle": "Rectangle", "circle": f"Radius · {s.radius / 1609.34:.2f} mi"}[s.kind]


def circle_ring(lat: Column, lon: Column, radius: Column, corners: int = 64) -> Column:
    """A circle as a ring of corners."""

    def corner(i: Column) -> Column:
        turn, d = 2 * math.pi * i / corners, radius / RADIUS_M
        to = F.asin(F.sin(F.radians(lat)) * F.cos(d) + F.cos(F.radians(lat)) * F.sin(d) * F.cos(turn))
        side = F.atan2(F.sin(turn) * F.sin(d) * F.cos(F.radians(lat)), F.cos(d) - F.sin(F.radians(lat)) * F.sin(to))
        return F.struct(F.degrees(to).alias("lat"), (lon + F.degrees(side)).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), corner)
