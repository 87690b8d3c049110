"""Points on the globe, as column expressions. Point (0, 0) stands for unknown."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
Box = tuple[float, float, float, float]  # lowest and highest latitude, lowest and highest longitude


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def arc_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.hypot(F.cos(p2) * F.sin(d), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))
    return F.degrees(F.atan2(y, F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(d)))


def offset_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.greatest(F.abs(lat2 - lat1), F.abs(lng2 - lng1) * F.greatest(F.cos(F.radians(lat1)), F.lit(0.1)))


def known(lat: Column, lng: Column) -> Column:
    return (lat != 0) | (lng != 0)


def valid(lat: Column, lng: Column) -> Column:
    return lat.between(-90, 90) & lng.between(-180, 180) & known(lat, lng)


def near_zero(v: Column) -> Column:
    return F.abs(v) < 0.5


def region(lat: Column, lng: Column) -> Column:
    """Rough continental bucket; the first box in order decides, so its gaps at 35 and 12 degrees fall through."""
    # Fixed: bounds and names of the regions, the first that holds.
    west = (lng >= -180) & (lng < -50)
    east = (lng >= 60) & (lng < 160)
    middle = (lng > -25) & (lng < 60)
    return (
        F.when(near_zero(lat) & near_zero(lng), "Unknown (no coords)")
        .when((lat > 35) & middle, "Europe")
        .when((lat > 12) & (lat < 35) & middle, "Mediterranean / Middle East / North Africa")
        .when((lat < 12) & (lng > -25) & (lng < 55), "Sub-Saharan Africa")
        .when((lat > 35) & east, "Central / North Asia")
        .when((lat <= 35) & (lat > -10) & east, "South / Southeast Asia")
        .when((lat > 35) & west, "North America")
        .when((lat <= 35) & (lat > 5) & west, "Central America / Caribbean")
        .when((lat <= 5) & (lng >= -90) & (lng < -30), "South America")
        .when((lng >= 110) & (lat <= -10), "Oceania")
        .when((lng >= 160) | (lng < -150), "Pacific")
        .otherwise("Other")
    )


def in_box(lat: Column, lng: Column, box: Box) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def outside_family_boxes(name: Column, lat: Column, lng: Column, families: Sequence[tuple[str, Sequence[Box]]]) -> Column:
    """Whether the boxes of the first family (pattern, boxes) that a name matches all leave the point out."""
    out = F.lit(False)
    for pattern, boxes in reversed(families):
        inside = F.lit(False)
        for b in boxes:
            inside = inside | in_box(lat, lng, b)
        out = F.when(F.lower(name).rlike(pattern), ~inside).otherwise(out)
    return known(lat, lng) & out


def first_box(lat: Column, lng: Column, boxes: Sequence[tuple[str, Box]]) -> Column:
    """The name of the first box that holds the point; null without one."""
    return F.coalesce(*(F.when(in_box(lat, lng, b), F.lit(name)) for name, b in boxes), F.lit(None).cast("string"))


#: Fixed: what an era was about in a box (lowest and highest latitude, lowest and highest longitude), the first that holds a point.
ERA_CONTEXT = {
    "napoleonic": (
        ("Napoleonic Wars", (35, 72, -10, 40)),
        ("Revolutionary America", (20, 60, -130, -50)),
        ("Latin American Independence", (-56, 25, -90, -30)),
        ("Late Mughal · East India Company", (5, 40, 60, 100)),
        ("Qing Dynasty", (18, 55, 100, 145)),
        ("Edo Period", (30, 46, 128, 146)),
        ("Ottoman Empire", (12, 42, 24, 65)),
    ),
    "industrial": (
        ("European Industrial Powers", (35, 72, -10, 40)),
        ("American Expansion · Civil War", (24, 60, -130, -65)),
        ("British Raj", (5, 40, 60, 100)),
        ("Late Qing · Meiji", (18, 55, 100, 145)),
        ("Meiji Restoration", (30, 46, 128, 146)),
        ("Ottoman Decline", (12, 42, 24, 65)),
        ("Scramble for Africa", (-35, 35, -20, 55)),
    ),
    "early-modern": (
        ("Wars of Religion · Early Empire", (35, 72, -10, 40)),
        ("Ming · Qing transition", (18, 55, 100, 145)),
        ("Sengoku · Tokugawa", (30, 46, 128, 146)),
        ("Mughal Empire", (5, 40, 60, 100)),
        ("Ottoman Empire at zenith", (12, 42, 24, 65)),
    ),
    "medieval": (
        ("European Middle Ages", (35, 72, -10, 40)),
        ("Tang · Song · Yuan · Ming", (18, 55, 100, 145)),
        ("Heian · Kamakura · Muromachi", (30, 46, 128, 146)),
        ("Caliphates · Crusader states", (12, 42, 24, 65)),
        ("Delhi Sultanate · Vijayanagara", (5, 40, 60, 100)),
    ),
    "ancient": (
        ("Mediterranean Antiquity", (35, 50, -10, 40)),
        ("Near East · Persia", (22, 45, 30, 60)),
        ("Imperial China", (18, 45, 100, 130)),
        ("Indian Antiquity", (5, 40, 60, 100)),
    ),
    "cold-war": (
        ("Indochina · Korea", (5, 30, 60, 130)),
        ("Latin American Cold War", (7, 30, -130, -65)),
        ("Iron Curtain", (35, 60, -10, 50)),
        ("Soviet-Afghan War", (28, 42, 60, 95)),
        ("Arab–Israeli wars", (12, 36, 25, 60)),
        ("Decolonisation · Proxy wars", (-35, 25, -20, 55)),
    ),
    "contemporary": (
        ("Russia–Ukraine War", (44, 56, 25, 45)),
        ("War on Terror · Syrian Civil War", (12, 40, 30, 50)),
        ("Afghanistan · GWOT", (28, 40, 60, 80)),
        ("Yugoslav Wars", (40, 48, 12, 30)),
        ("African insurgencies", (-35, 20, -20, 55)),
        ("South China Sea era", (5, 30, 100, 130)),
    ),
}


def era_context(era: Column, lat: Column, lng: Column) -> Column:
    """What an era was about where a point lies; '' for eras and places without an entry."""
    return F.coalesce(*(F.when(era == name, first_box(lat, lng, boxes)) for name, boxes in ERA_CONTEXT.items()), F.lit(""))


def parse_wkt_point(text: Column) -> Column:
    """struct(lat, lng) of Point(lng lat); null for other texts."""
    p = r"^Point\((-?[0-9.]+) (-?[0-9.]+)\)$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 2).try_cast("double").alias("lat"), F.regexp_extract(text, p, 1).try_cast("double").alias("lng")))


def parse_query_point(text: Column) -> Column:
    """struct(lat, lng) of 'lat, lng' or 'lat lng' in range; null else."""
    p = r"^\s*(-?\d{1,3}(?:\.\d+)?)\s*[, ]\s*(-?\d{1,3}(?:\.\d+)?)\s*$"
    lat, lng = (F.regexp_extract(text, p, k).try_cast("double") for k in (1, 2))
    return F.when(text.rlike(p) & lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))


def parse_coord_template(text: Column) -> Column:
    """struct(lat, lng) of a coordinate template's arguments: degrees, minutes, seconds before hemisphere letters, else decimals."""
    args = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\{\{\s*coord\s*\|([^}]*)\}\}", 1)
    number = r"\s*(\d+(?:\.\d+)?)\s*"
    dms = rf"(?i)^{number}(?:\|{number})?(?:\|{number})?\|\s*([NS])\s*\|{number}(?:\|{number})?(?:\|{number})?\|\s*([EW])"
    part = lambda k: F.coalesce(F.regexp_extract(args, dms, k).try_cast("double"), F.lit(0.0))
    angle = lambda k, letter, negative: (part(k) + part(k + 1) / 60 + part(k + 2) / 3600) * F.when(F.upper(F.regexp_extract(args, dms, letter)) == negative, -1.0).otherwise(1.0)
    plain = r"^\s*(-?\d+(?:\.\d+)?)\s*\|\s*(-?\d+(?:\.\d+)?)"
    lat = F.when(args.rlike(dms), angle(1, 4, "S")).when(args.rlike(plain), F.regexp_extract(args, plain, 1).try_cast("double"))
    lng = F.when(args.rlike(dms), angle(5, 8, "W")).when(args.rlike(plain), F.regexp_extract(args, plain, 2).try_cast("double"))
    return F.when(valid(lat, lng), F.struct(lat.alias("lat"), lng.alias("lng")))


def mirrored(lat1: Column, lng1: Column, lat2: Column, lng2: Column, near: float = 0.5) -> Column:
    """Whether one point is the other with a sign or the axes exchanged."""
    close = lambda a, b, c, d: (F.abs(a - c) < near) & (F.abs(b - d) < near)
    return ~close(lat1, lng1, lat2, lng2) & (close(-lat1, lng1, lat2, lng2) | close(lat1, -lng1, lat2, lng2) | close(-lat1, -lng1, lat2, lng2) | close(lng1, lat1, lat2, lng2))


def decide_point(lat: Column, lng: Column, other_lat: Column, other_lng: Column, votes: Column, far_km: float = 50.0) -> Column:
    """'keep' near the other source, 'move' if unknown, mirrored or outvoted (two votes), 'disputed' else."""
    return F.when(~known(lat, lng), "move").when(haversine_km(lat, lng, other_lat, other_lng) <= far_km, "keep").when(mirrored(lat, lng, other_lat, other_lng) | (votes >= 2), "move").otherwise("disputed")


def consensus(points: Column, near_km: float = 50.0) -> Column:
    """Of an array of structs (lat, lng): the first with another one near it, with its votes; a lone point has one vote."""
    votes = F.transform(points, lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"), F.size(F.filter(points, lambda q: haversine_km(p["lat"], p["lng"], q["lat"], q["lng"]) <= near_km)).alias("votes")))
    backed = F.filter(votes, lambda v: v["votes"] >= 2)
    return F.coalesce(F.try_element_at(backed, F.lit(1)), F.when(F.size(points) == 1, F.try_element_at(votes, F.lit(1))))


def ring_centroid(ring: Column) -> Column:
    """Mean vertex of an array of structs (lat, lng)."""
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[f]) / F.size(ring)
    return F.struct(mean("lat").alias("lat"), mean("lng").alias("lng"))


def unwrapped(ring: np.ndarray) -> np.ndarray:
    """A ring of (lng, lat) without jumps at the date line: the path of its edges, each the shorter way round, with the
    westernmost point in -180..180.

    The edges of a ring that goes round the globe turn by 360 degrees in all. Such a ring holds the pole on the side of its
    mean latitude along its length, and a cut along the meridian of its ends leads there and back.
    """
    ring = np.asarray(ring, float)
    if len(ring) < 2:
        return ring
    lng, lat = ring.T
    steps = np.diff(lng)
    steps = steps - 360 * np.rint(steps / 360)
    path = np.concatenate([lng[:1], lng[0] + np.cumsum(steps)])
    home = lng[0] - path[-1]
    winding = (steps.sum() + home - 360 * np.rint(home / 360)) / 360
    if abs(winding) > 0.5:
        length = np.hypot(steps, np.diff(lat))
        pole = np.copysign(90.0, (length * (lat[1:] + lat[:-1])).sum())
        path, lat = np.concatenate([path, path[[-1, 0, 0]]]), np.concatenate([lat, [pole, pole, lat[0]]])
    west = path.min()
    return np.column_stack([path + (np.mod(west + 180, 360) - 180 - west), lat])


def stitched(arcs: Sequence[np.ndarray], indices: Sequence[int]) -> np.ndarray:
    """One ring from decoded arcs (lng, lat) in order: a negative index ~i is arc i backwards, joints stand once."""
    parts = [arcs[i] if i >= 0 else arcs[~i][::-1] for i in indices]
    return unwrapped(np.concatenate([parts[0], *(p[1:] for p in parts[1:])]))


def rings_contain(lat: np.ndarray, lng: np.ndarray, rings: Sequence[np.ndarray]) -> np.ndarray:
    """Even-odd ray casting of points against rings of (lng, lat), each with a bounding-box test first. Southern and western edges belong to a ring."""
    inside = np.zeros(len(lat), bool)
    for ring in rings:
        x, y = ring[:, 0], ring[:, 1]
        near = (lat >= y.min()) & (lat <= y.max()) & (lng <= x.max())
        if not near.any():
            continue
        x2, y2 = np.roll(x, -1), np.roll(y, -1)
        la, ln = lat[near][:, None], lng[near][:, None]
        crosses = (y > la) != (y2 > la)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (x2 - x) * (la - y) / (y2 - y) + x
        inside[near] ^= ((crosses & (ln < at)).sum(axis=1) % 2).astype(bool)
    return inside


def within_rings(rings: Sequence[np.ndarray], tolerance_km: float = 0.0):
    """A function (lat, lng) -> boolean column: in the rings, or within tolerance_km of their edges.

    The rings go to the tasks with the function: a country's or the world's outline, a bounded input.
    """
    rings = [np.asarray(r, float) for r in rings]

    def test(lat: pd.Series, lng: pd.Series) -> pd.Series:
        a, b = lat.to_numpy(float), lng.to_numpy(float)
        inside = rings_contain(a, b, rings)
        if tolerance_km:
            for i in np.flatnonzero(~inside & np.isfinite(a) & np.isfinite(b)):
                scale = np.array([np.cos(np.radians(a[i])), 1.0]) * (np.pi * EARTH_KM / 180)
                for ring in rings:
                    p = (ring - [b[i], a[i]]) * scale
                    q = np.roll(p, -1, axis=0)
                    d = q - p
                    t = np.clip(-(p * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-12), 0, 1)
                    if np.hypot(*(p + t[:, None] * d).T).min() <= tolerance_km:
                        inside[i] = True
                        break
        return pd.Series(inside)

    return F.pandas_udf(test, "boolean")
