"""Points against outlines of any number and size, by a grid: no point meets an edge that is not near it.

An outline is a ring of edges on the sphere's (lng, lat) plane; an edge goes the shorter way round. The grid's cells hold
the edges that pass through them. Whether a cell's centre lies in a ring follows from the ring's crossings of the centre's
meridian to the north, which are counted by row of cells and summed along the column. A point's own answer is that of its
cell's centre, turned by each edge of the cell that lies between the two on the way along the point's meridian and then along the
centre's latitude. So no ring is unwrapped or closed through a pole: one that winds round the globe holds the pole on
its own side, and the north pole's answer is where the counting begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 0.5  # degrees; a whole number of them makes a turn
KM_PER_DEGREE_LAT, KM_PER_DEGREE_LNG = 110.57, 111.32


def turn(a: Column, b: Column) -> Column:
    """The shorter way from one longitude to another, in -180 .. 180."""
    return F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0


def ring_edges(vertices: DataFrame) -> DataFrame:
    """(ring, at, x, y, dx, dy, closes) of vertices (ring, at, lng, lat): each edge from its western or eastern start; the last one closes the ring."""
    w = Window.partitionBy("ring").orderBy("at")
    rows = vertices.withColumn("_n", F.lead(F.struct("lng", "lat")).over(w)).withColumn("_f", F.first(F.struct("lng", "lat")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    to = F.coalesce("_n", "_f")
    dx = F.when((F.abs(F.col("lng")) == 180) & (to["lng"] == -F.col("lng")), 0.0).otherwise(turn(F.col("lng"), to["lng"]))
    edges = rows.select("ring", "at", F.col("lng").cast("double").alias("x"), F.col("lat").cast("double").alias("y"), dx.cast("double").alias("dx"), (to["lat"] - F.col("lat")).cast("double").alias("dy"), F.col("_n").isNull().alias("closes"))
    return edges.filter("dx != 0 or dy != 0")


def holds_north_pole(edges: DataFrame) -> DataFrame:
    """(ring) of the rings that wind round the globe on the northern side, by their mean latitude along their length."""
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    by = edges.groupBy("ring").agg(F.round(F.sum("dx") / 360.0).alias("turns"), (F.sum((F.col("y") + F.col("dy") / 2) * length) / F.sum(length)).alias("mean"))
    return by.filter((F.pmod("turns", F.lit(2)) != 0) & (F.col("mean") >= 0)).select("ring")


def columns_passed(edges: DataFrame, cell: float) -> DataFrame:
    """The edges once for each column of cells that they touch; x is moved by whole turns so that the column lies in 0 .. 360 / cell."""
    number = round(360 / cell)
    low, high = F.least(F.col("x"), F.col("x") + F.col("dx")), F.greatest(F.col("x"), F.col("x") + F.col("dx"))
    place = lambda v: F.floor((v + 180.0) / cell)
    each = edges.withColumn("_c", F.explode(F.sequence(place(low), place(high))))
    return each.withColumn("col", F.pmod("_c", F.lit(number))).withColumn("x", F.col("x") - (F.floor(F.col("_c") / number) * 360.0)).drop("_c")


def cells_passed(edges: DataFrame, cell: float) -> DataFrame:
    """The edges once for each cell (col, row) that the part within a column may touch."""
    each = columns_passed(edges, cell)
    west = F.col("col") * cell - 180.0
    at = lambda x: F.when(F.col("dx") == 0, F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x")) / F.col("dx"))))
    share = lambda t, other: F.col("y") + F.coalesce(t, F.lit(other)) * F.col("dy")
    a, b = share(at(west), 0.0), share(at(west + cell), 1.0)
    row = lambda y: F.floor((F.greatest(F.lit(-90.0), F.least(F.lit(90.0), y)) + 90.0) / cell)
    slack = 1e-9  # for rounding, an edge on a cell's border is dealt to both
    return each.withColumn("row", F.explode(F.sequence(row(F.least(a, b) - slack), row(F.greatest(a, b) + slack))))


def inner_cells(edges: DataFrame, cell: float) -> DataFrame:
    """(ring, col, row) of the cells whose centres lie in a ring."""
    rows_of = round(180 / cell)
    each = columns_passed(edges, cell)
    middle = (F.col("col") + 0.5) * cell - 180.0
    west, east = F.least(F.col("x"), F.col("x") + F.col("dx")), F.greatest(F.col("x"), F.col("x") + F.col("dx"))
    lat = F.col("y") + (middle - F.col("x")) / F.col("dx") * F.col("dy")
    # A crossing lies north of the centres of the rows below this one.
    crossed = each.filter((F.col("dx") != 0) & (west <= middle) & (middle < east)).select("ring", "col", F.ceil((lat + 90.0) / cell - 0.5).alias("below"))
    polar = holds_north_pole(edges)
    top = polar.select("ring", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(round(360 / cell) - 1).cast("long"))).alias("col")).withColumn("below", F.lit(rows_of).cast("long"))
    # Crossings of a column from the north: between two that follow each other every second stretch lies in the ring.
    w = Window.partitionBy("ring", "col").orderBy(F.desc("below"))
    counts = crossed.unionByName(top).groupBy("ring", "col", "below").agg(F.count("*").alias("n"))
    runs = counts.withColumn("_odd", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1).withColumn("_to", F.coalesce(F.lead("below").over(w), F.lit(0)))
    inside = runs.filter(F.col("_odd") & (F.col("below") > F.col("_to")))
    return inside.select("ring", "col", F.explode(F.sequence(F.greatest(F.col("_to"), F.lit(0)), F.least(F.col("below"), F.lit(rows_of)) - 1)).alias("row"))


def located(points: DataFrame, cell: float) -> DataFrame:
    """The points with a longitude in -180 .. 180 and their cell."""
    lng = F.pmod(F.col("lng") + 180.0, F.lit(360.0)) - 180.0
    row = F.least(F.floor((F.col("lat") + 90.0) / cell), F.lit(round(180 / cell) - 1))
    return points.withColumn("_lng", lng).withColumn("col", F.pmod(F.floor((F.col("_lng") + 180.0) / cell), F.lit(round(360 / cell)))).withColumn("row", row)


def sited(points: DataFrame, cell: float) -> DataFrame:
    """(id, lat, lng, _lng, col, row) of the points (id, lat, lng) that have a place."""
    return located(points.filter("lat between -90 and 90 and lng is not null and not isnan(lng)").select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")), cell)


def held(sure: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """(id, ring) of sited points and the rings that they lie in."""
    centre_x, centre_y = (F.col("col") + 0.5) * cell - 180.0, (F.col("row") + 0.5) * cell - 90.0
    near = sure.join(cells_passed(edges, cell), ["col", "row"])
    x1, x2, y1, y2 = F.col("x"), F.col("x") + F.col("dx"), F.col("y"), F.col("y") + F.col("dy")
    px, py = F.col("_lng"), F.col("lat")
    # Along the point's meridian to the centre's latitude, then along this latitude to the centre.
    at_px = y1 + (px - x1) / F.col("dx") * F.col("dy")
    first = (F.least(x1, x2) <= px) & (px < F.greatest(x1, x2)) & ((at_px > py) != (at_px > centre_y))
    at_cy = x1 + (centre_y - y1) / F.col("dy") * F.col("dx")
    second = (F.least(y1, y2) <= centre_y) & (centre_y < F.greatest(y1, y2)) & ((at_cy > px) != (at_cy > centre_x))
    hits = F.when(F.col("dx") != 0, first).otherwise(False).cast("int") + F.when(F.col("dy") != 0, second).otherwise(False).cast("int")
    turned = near.select("id", "ring", hits.alias("_n")).groupBy("id", "ring").agg(F.sum("_n").alias("_n"))
    centred = sure.join(inner_cells(edges, cell), ["col", "row"]).select("id", "ring", F.lit(1).cast("long").alias("_n"))
    return turned.unionByName(centred).groupBy("id", "ring").agg(F.sum("_n").alias("_n")).filter("_n % 2 = 1").select("id", "ring")


def within(points: DataFrame, edges: DataFrame, cell: float = CELL) -> DataFrame:
    """(id, ring) of the points (id, lat, lng) and the rings that they lie in; ids are one a point. Points without a place lie in none."""
    return held(sited(points, cell), edges, cell)


def one_of_equal(edges: DataFrame) -> DataFrame:
    """The edges of one ring of each set of rings that have the same edges, by two hashes of 64 bits."""
    place = ("x", "y", "dx", "dy")
    prints = edges.groupBy("ring").agg(F.count("*").alias("_n"), F.sum(F.xxhash64(*place).cast("decimal(20,0)")).alias("_a"), F.sum(F.xxhash64(F.lit("again"), *place).cast("decimal(20,0)")).alias("_b"))
    return edges.join(prints.groupBy("_n", "_a", "_b").agg(F.min("ring").alias("ring")).select("ring"), "ring", "left_semi")


def covered_cells(edges: DataFrame, cell: float) -> DataFrame:
    """(col, row) of the cells that lie in a ring as a whole: their centres do, and no edge of the ring touches them."""
    return inner_cells(edges, cell).join(cells_passed(edges, cell).select("ring", "col", "row"), ["ring", "col", "row"], "left_anti").select("col", "row").distinct()


def within_any(points: DataFrame, edges: DataFrame, cell: float = CELL) -> DataFrame:
    """(id) of the points in at least one ring. Points in covered cells meet no edge, however many rings lie over each other."""
    sure, shapes = sited(points, cell), one_of_equal(edges)
    covered = covered_cells(shapes, cell)
    rest = held(sure.join(covered, ["col", "row"], "left_anti"), shapes, cell).select("id").distinct()
    return sure.join(covered, ["col", "row"], "left_semi").select("id").unionByName(rest)


def near_edges(points: DataFrame, edges: DataFrame, km: float, cell: float = CELL) -> DataFrame:
    """(id) of the points within km of an edge that is no closing one, on a plane around the point."""
    sure = sited(points, cell)
    number, rows_of = round(360 / cell), round(180 / cell)
    wide = F.greatest(F.cos(F.radians("lat")), F.lit(0.01))
    reach_x, reach_y = F.ceil(km / (KM_PER_DEGREE_LNG * wide) / cell), int(-(-km // (KM_PER_DEGREE_LAT * cell)))
    around = sure.withColumn("_wide", wide).withColumn("_reach", F.least(reach_x, F.lit((number - 1) // 2))).withColumn("_c", F.explode(F.sequence(F.col("col") - F.col("_reach"), F.col("col") + F.col("_reach"))))
    around = around.withColumn("row", F.explode(F.sequence(F.greatest(F.col("row") - reach_y, F.lit(0)), F.least(F.col("row") + reach_y, F.lit(rows_of - 1)))))
    around = around.withColumn("col", F.pmod("_c", F.lit(number))).withColumn("_px", F.col("_lng") - F.floor(F.col("_c") / number) * 360.0)
    pairs = around.join(cells_passed(edges.filter("not closes").select("x", "y", "dx", "dy").distinct(), cell), ["col", "row"])
    ax, ay = (F.col("x") - F.col("_px")) * KM_PER_DEGREE_LNG * F.col("_wide"), (F.col("y") - F.col("lat")) * KM_PER_DEGREE_LAT
    ex, ey = F.col("dx") * KM_PER_DEGREE_LNG * F.col("_wide"), F.col("dy") * KM_PER_DEGREE_LAT
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * ex + ay * ey) / (ex * ex + ey * ey)))
    close = F.sqrt(F.pow(ax + t * ex, 2) + F.pow(ay + t * ey, 2)) <= km
    return pairs.filter(close).select("id").distinct()


def judged(points: DataFrame, edges: DataFrame, km: float, cell: float = CELL) -> DataFrame:
    """The points (id, lat, lng) with inside (in an outline) and land (in one, or within km of one); both false for points without a place.

    Each place is judged once, however many points stand there, and only places outside of all outlines are held against edges near them.
    """
    at = F.struct(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    places = points.select(at.alias("id")).distinct().select("id", "id.lat", "id.lng")
    inside = within_any(places, edges, cell).withColumn("inside", F.lit(True))
    told = inside
    if km:
        rest = places.join(inside, "id", "left_anti")
        told = inside.unionByName(near_edges(rest, edges, km, cell).withColumn("inside", F.lit(False)))
    met = points.withColumn("_at", at).join(told.select(F.col("id").alias("_at"), "inside", F.lit(True).alias("land")), "_at", "left").drop("_at")
    return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("inside", "land")})


def on_land(points: DataFrame, edges: DataFrame, km: float = 15.0, cell: float = CELL) -> DataFrame:
    """The points (id, lat, lng) with land: in an outline, or within km of one; false for points without a place."""
    return judged(points, edges, km, cell).drop("inside")
