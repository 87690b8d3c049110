"""Replays held against their rules: findings over phases, units and movements in one pass over each replay's nested lists.

Two sets of rules: the loose one of served replays, and the strict one of drafts, which also ties every place to the event
that the replay shows. A finding is (id, path, message); the path says where, as in phases[2].units[0].faction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronika.functions import geo

UNIT = "struct<id:string,label:string,faction:string,x:double,y:double,lat:double,lng:double>"
MOVEMENT = "struct<faction:string,fromX:double,fromY:double,fromLat:double,fromLng:double,toX:double,toY:double,toLat:double,toLng:double>"
PHASE = f"struct<index:int,title:string,narration:string,durationMs:int,cameraLat:double,cameraLng:double,units:array<{UNIT}>,movements:array<{MOVEMENT}>>"
REPLAY = f"id string, title string, intro string, factionA string, factionB string, phases array<{PHASE}>"
FINDING = "struct<path:string,message:string>"

#: Fixed: how many phases, how long each, how far from the event in degrees, and the sides of the palette.
LEAST_PHASES, MOST_PHASES = 3, 12
SHORTEST_MS, LONGEST_MS = 5000, 11000
FAR_DEGREES = 6.0
FACTIONS = ("a", "b", "c")


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""


def number(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def listed(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.expr(f"cast(array() as array<{kind}>)"))


def found(*checks: tuple[Column, Column, str | Column]) -> Column:
    """An array of the findings (when, path, message) that hold."""
    each = [F.when(F.coalesce(when, F.lit(False)), F.struct(path.alias("path"), (F.lit(m) if isinstance(m, str) else m).alias("message"))) for when, path, m in checks]
    return F.array_compact(F.array(*each)).cast(f"array<{FINDING}>")


def under(path: Column, name: str, i: Column) -> Column:
    return F.concat(path, F.lit(f".{name}["), i.cast("string"), F.lit("]"))


def at(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def each(items: Column, path: Column, name: str, rule: Callable[[Column, Column], Column]) -> Column:
    """The findings of a rule (item, path) over a nested list, in order."""
    return F.flatten(F.transform(items, lambda x, i: rule(x, under(path, name, i))))


def faction(value: Column, path: Column) -> tuple[Column, Column, Column]:
    return ~F.coalesce(value, F.lit("")).isin(*FACTIONS), at(path, "faction"), F.concat(F.lit('"'), F.coalesce(value, F.lit("")), F.lit('" is not a, b or c'))


def in_field(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & number(v).between(0, 100)
    return out


def served_findings() -> Column:
    def unit(u: Column, path: Column) -> Column:
        return found(faction(u["faction"], path), (~in_field(u["x"], u["y"]), path, F.format_string("x,y %.1f,%.1f outside 0..100", number(u["x"]), number(u["y"]))))

    def movement(m: Column, path: Column) -> Column:
        return found((~in_field(m["fromX"], m["fromY"], m["toX"], m["toY"]), path, "coordinates outside 0..100"))

    def phase(p: Column, i: Column) -> Column:
        path = F.concat(F.lit("phases["), i.cast("string"), F.lit("]"))
        own = found((blank(p["title"]), at(path, "title"), "required"), (blank(p["narration"]), at(path, "narration"), "required"))
        return F.concat(own, each(listed(p["units"], UNIT), path, "units", unit), each(listed(p["movements"], MOVEMENT), path, "movements", movement))

    phases = listed(F.col("phases"), PHASE)
    few = F.concat(F.lit(f"need at least {LEAST_PHASES} phases, got "), F.size(phases).cast("string"))
    whole = found((blank(F.col("factionA")) | blank(F.col("factionB")), F.lit("factionA,factionB"), "both are required"), (F.size(phases) < LEAST_PHASES, F.lit("phases"), few))
    return F.concat(whole, F.flatten(F.transform(phases, phase)))


def place(x: Column, y: Column, lat: Column, lng: Column, anchor_lat: Column, anchor_lng: Column, path: Column) -> tuple[tuple[Column, Column, Column], ...]:
    """The findings of one place: on the globe if it has a latitude or longitude, else in the field."""
    x, y, lat, lng = map(number, (x, y, lat, lng))
    globe = (lat != 0) | (lng != 0)
    outside = (F.abs(lat) > 90) | (F.abs(lng) > 180)
    far = geo.offset_degrees(anchor_lat, anchor_lng, lat, lng) > FAR_DEGREES
    return (
        (globe & outside, path, F.format_string("lat/lng %.4f,%.4f out of range", lat, lng)),
        (globe & ~outside & far, path, F.format_string(f"lat/lng %.4f,%.4f more than {FAR_DEGREES:.0f} degrees from the event", lat, lng)),
        (~globe & ~in_field(x, y), path, F.format_string("x/y %.1f,%.1f outside 0..100", x, y)),
        (~globe & (x == 50) & (y == 50), path, F.lit("x/y is the 50,50 placeholder")),
    )


def draft_findings(anchor_lat: Column, anchor_lng: Column) -> Column:
    def unit(units: Column) -> Callable[[Column, Column, Column], Column]:
        def rule(u: Column, i: Column, path: Column) -> Column:
            again = (F.coalesce(u["id"], F.lit("")) != "") & F.exists(F.slice(units, F.lit(1), i), lambda v: v["id"] == u["id"])
            return found(faction(u["faction"], path), (again, at(path, "id"), F.concat(F.lit('duplicate id "'), u["id"], F.lit('"'))), *place(u["x"], u["y"], u["lat"], u["lng"], anchor_lat, anchor_lng, path))

        return rule

    def movement(m: Column, path: Column) -> Column:
        ends = (place(m[f"{k}X"], m[f"{k}Y"], m[f"{k}Lat"], m[f"{k}Lng"], anchor_lat, anchor_lng, at(path, k)) for k in ("from", "to"))
        return found(faction(m["faction"], path), *(c for e in ends for c in e))

    def phase(p: Column, i: Column) -> Column:
        path = F.concat(F.lit("phases["), i.cast("string"), F.lit("]"))
        units = listed(p["units"], UNIT)
        long = F.coalesce(p["durationMs"], F.lit(0))
        lat, lng = number(p["cameraLat"]), number(p["cameraLng"])
        own = found(
            (F.coalesce(p["index"], F.lit(0)) != i, at(path, "index"), F.concat(F.coalesce(p["index"], F.lit(0)).cast("string"), F.lit(" is not its position"))),
            (blank(p["title"]), at(path, "title"), "empty"),
            (blank(p["narration"]), at(path, "narration"), "empty"),
            (~long.between(SHORTEST_MS, LONGEST_MS), at(path, "durationMs"), F.concat(long.cast("string"), F.lit(f" outside {SHORTEST_MS}..{LONGEST_MS}"))),
            (F.size(units) == 0, at(path, "units"), "none"),
        )
        camera = found((((lat != 0) | (lng != 0)) & (geo.offset_degrees(anchor_lat, anchor_lng, lat, lng) > FAR_DEGREES), at(path, "camera"), F.format_string("%.3f,%.3f too far from the event", lat, lng)))
        judged = F.flatten(F.transform(units, lambda u, j: unit(units)(u, j, under(path, "units", j))))
        return F.concat(own, judged, each(listed(p["movements"], MOVEMENT), path, "movements", movement), camera)

    phases = listed(F.col("phases"), PHASE)
    whole = found(
        (blank(F.col("id")), F.lit("id"), "empty"),
        (blank(F.col("title")), F.lit("title"), "empty"),
        (blank(F.col("intro")), F.lit("intro"), "empty"),
        (blank(F.col("factionA")) | blank(F.col("factionB")), F.lit("factionA,factionB"), "both are required"),
        (~F.size(phases).between(LEAST_PHASES, MOST_PHASES), F.lit("phases"), F.concat(F.size(phases).cast("string"), F.lit(f" outside {LEAST_PHASES}..{MOST_PHASES}"))),
    )
    return F.concat(whole, F.flatten(F.transform(phases, phase)))


def validate_served(replays: DataFrame) -> DataFrame:
    """(id, path, message) of served replays (REPLAY); null texts count as blank, null numbers as 0, null lists as empty."""
    return replays.select("id", F.explode(served_findings()).alias("f")).select("id", "f.path", "f.message")


def validate_drafts(replays: DataFrame, events: DataFrame) -> DataFrame:
    """(id, path, message) of drafts, held against the points of their events (id, lat, lng); a draft without an event has the finding 'no event' alone."""
    rows = replays.join(events.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), "id", "left")
    lost = found((F.lit(True), F.lit("id"), "no event"))
    told = F.when(F.col("_lat").isNull() & ~blank(F.col("id")), lost).otherwise(draft_findings(number(F.col("_lat")), number(F.col("_lng"))))
    return rows.select("id", F.explode(told).alias("f")).select("id", "f.path", "f.message")


def accepted(replays: DataFrame, events: DataFrame) -> DataFrame:
    """The drafts without a finding."""
    return replays.join(validate_drafts(replays, events).select("id").distinct(), "id", "left_anti")
