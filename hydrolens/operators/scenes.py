"""Satellite-scene enrichment: spatial containment, best scene in a time
window, and nearest-pixel band sampling -- all as equi joins.

A pure interval/containment condition plans as a nested-loop join.  Both
sides here get equi keys instead: a grid cell (scenes are exploded to the
few cells their footprint covers, a sample has one) and, for the best scene,
a time bucket (a scene has one bucket, a sample is exploded to the buckets its
window touches).  Smaller cells and buckets mean fewer false candidates before
the exact check, at the price of more exploded rows, and every exploded row is
shuffled.  The best scene therefore meets in square tiles of ``TILE_CELLS``
cells a side and buckets as long as the window: a footprint four cells wide is
copied 2.25 times on average (25 times by cells), a sample twice.  Each
(sample, scene) pair meets in exactly one (tile, bucket), so no candidate is
duplicated; the exact footprint and half-open time window are re-checked after
the equi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CELL_DEG = 0.25     # ~ a quarter of a Sentinel-2 tile: few cells per footprint, few false candidates
DEFAULT_WINDOW_DAYS = 30
TILE_CELLS = 8              # cells to a side of the tiles in which samples meet the scenes of their window


def _cell(c, size):
    return F.floor(F.col(c) / F.lit(size)).cast("long")


def _scene_keys(scenes: DataFrame, cell_deg: float, bucket_days: int) -> DataFrame:
    """Scenes exploded to the grid cells of ``cell_deg`` their footprint covers, +
    time bucket."""
    day = F.unix_date(F.col("acquired_at").cast("date"))
    return (scenes
            .withColumn("_cx", F.explode(F.sequence(_cell("min_lon", cell_deg), _cell("max_lon", cell_deg))))
            .withColumn("_cy", F.explode(F.sequence(_cell("min_lat", cell_deg), _cell("max_lat", cell_deg))))
            .withColumn("_tb", F.floor(day / F.lit(bucket_days)).cast("long")))


def _sample_keys(samples: DataFrame, lon: str, lat: str, date: str, cell_deg: float,
                 window_days: int, bucket_days: int) -> DataFrame:
    """Samples with their cell and the time buckets of [date - w, date + w)."""
    d = F.unix_date(F.col(date).cast("date"))
    first = F.floor((d - window_days) / F.lit(bucket_days)).cast("long")
    last = F.floor((d + window_days - 1) / F.lit(bucket_days)).cast("long")
    return (samples.withColumn("_cx", _cell(lon, cell_deg)).withColumn("_cy", _cell(lat, cell_deg))
            .withColumn("_tb", F.explode(F.sequence(first, last))))


def _seconds_between(a, b):
    """b - a in whole seconds for TIMESTAMP_NTZ values (no time-zone or DST
    dependence)."""
    days = F.unix_date(b.cast("date")) - F.unix_date(a.cast("date"))
    sod = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return days.cast("long") * 86400 + sod(b) - sod(a)


def contains(lon: str = "longitude", lat: str = "latitude"):
    """Point inside a scene footprint (inclusive bounding box)."""
    return (F.col(lon).between(F.col("min_lon"), F.col("max_lon"))
            & F.col(lat).between(F.col("min_lat"), F.col("max_lat")))


def containing_scenes(samples: DataFrame, scenes: DataFrame, key: str = "sample_id",
                      lon: str = "longitude", lat: str = "latitude",
                      cell_deg: float = DEFAULT_CELL_DEG) -> DataFrame:
    """All (sample, scene) pairs where the point lies in the footprint
    (grid-cell equi join + exact refine)."""
    sc = scenes.withColumn("_cx", F.explode(F.sequence(_cell("min_lon", cell_deg), _cell("max_lon", cell_deg)))) \
               .withColumn("_cy", F.explode(F.sequence(_cell("min_lat", cell_deg), _cell("max_lat", cell_deg))))
    sm = samples.select(key, lon, lat).withColumn("_cx", _cell(lon, cell_deg)).withColumn("_cy", _cell(lat, cell_deg))
    return (sm.hint("merge").join(sc, ["_cx", "_cy"], "inner").where(contains(lon, lat))
            .select(key, "scene_id"))


# ---------------------------------------------------------------- outlines of any shape
def ring_edges(ring):
    """(x1, y1, x2, y2) of every edge of a ring of lon/lat points; the last point
    is joined to the first."""
    return F.transform(ring, lambda p, i: F.struct(
        p["lon"].alias("x1"), p["lat"].alias("y1"), F.get(ring, (i + 1) % F.size(ring))["lon"].alias("x2"),
        F.get(ring, (i + 1) % F.size(ring))["lat"].alias("y2")))


def in_ring(x, y, edges):
    """Point inside a ring by edge crossings (even-odd); a point on an edge is
    inside."""
    def on(e):
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return ((turn == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    def crossed(e):
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return straddles & (x < at)
    crossings = F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False))))
    return F.exists(edges, on) | (crossings % 2 == 1)


def _cover(cells: DataFrame, size: float) -> DataFrame:
    """``cells`` (scene_id, edges, cx, cy) that the outline touches, with
    ``border``: whether an edge may pass through (else the cell is all inside)."""
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    near = F.exists("edges", lambda e: (F.least(e["x1"], e["x2"]) <= x0 + size) & (F.greatest(e["x1"], e["x2"]) >= x0)
                    & (F.least(e["y1"], e["y2"]) <= y0 + size) & (F.greatest(e["y1"], e["y2"]) >= y0))
    marked = cells.withColumn("border", near)
    return marked.where(F.col("border") | in_ring(x0 + size / 2, y0 + size / 2, F.col("edges")))


def cells_of_outlines(outlines: DataFrame, cell_deg: float = DEFAULT_CELL_DEG, refine: int = 4):
    """Two tables of cells per outline (scene_id, ring): coarse cells that lie all
    inside, and the fine cells (``refine`` to a side) of the coarse border cells.
    ``border`` fine cells need the exact test.  Outlines of fewer than three
    points cover nothing."""
    d = outlines.where(F.size("ring") >= 3).select("scene_id", ring_edges(F.col("ring")).alias("edges"))
    span = lambda a: F.sequence(F.floor(F.array_min(F.transform("edges", lambda e: e[a])) / cell_deg),
                                F.floor(F.array_max(F.transform("edges", lambda e: e[a])) / cell_deg))
    d = d.withColumn("cx", F.explode(span("x1"))).withColumn("cy", F.explode(span("y1")))
    coarse = _cover(d, cell_deg)
    steps = F.sequence(F.lit(0), F.lit(refine - 1))
    fine = (coarse.where("border").withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
            .select("scene_id", "edges", (F.col("cx") * refine + F.col("i")).alias("cx"),
                    (F.col("cy") * refine + F.col("j")).alias("cy")))
    # cells that need no test carry no edges, the others those that can decide it: a point has an edge on it or to its right
    size, slack = cell_deg / refine, cell_deg / refine * 1e-6
    decides = lambda e: ((F.greatest(e["x1"], e["x2"]) >= F.col("cx") * size - slack)
                         & (F.greatest(e["y1"], e["y2"]) >= F.col("cy") * size - slack)
                         & (F.least(e["y1"], e["y2"]) <= (F.col("cy") + 1) * size + slack))
    fine = _cover(fine, size).select("scene_id", "cx", "cy", "border",
                                     F.when(F.col("border"), F.filter("edges", decides)).alias("edges"))
    return coarse.where(~F.col("border")).select("scene_id", "cx", "cy"), fine


def containing_outlines(samples: DataFrame, outlines: DataFrame, key: str = "sample_id", lon: str = "longitude",
                        lat: str = "latitude", cell_deg: float = DEFAULT_CELL_DEG, refine: int = 4) -> DataFrame:
    """(sample, scene) pairs where the point lies in the scene's outline.  Points
    meet coarse inside cells and fine cells by equal cell numbers; only points in
    a fine border cell are tested edge by edge, and a place once for all its
    samples.  Samples without a place match nothing."""
    inside, fine = cells_of_outlines(outlines, cell_deg, refine)
    size = cell_deg / refine
    p = samples.select(key, F.col(lon).cast("double").alias("_x"), F.col(lat).cast("double").alias("_y")).where(
        "_x IS NOT NULL AND _y IS NOT NULL")
    at = p.select("_x", "_y").distinct().withColumns({"cx": F.floor(F.col("_x") / size), "cy": F.floor(F.col("_y") / size)})
    coarse = at.select("_x", "_y", F.floor(F.col("cx") / refine).alias("cx"), F.floor(F.col("cy") / refine).alias("cy"))
    exact = ~F.col("border") | in_ring(F.col("_x"), F.col("_y"), F.col("edges"))
    # the explodes hide the cells' number from the static estimate: shuffle both sides, never broadcast them
    met = (coarse.hint("merge").join(inside, ["cx", "cy"]).select("_x", "_y", "scene_id")
           .unionByName(at.hint("merge").join(fine, ["cx", "cy"]).where(exact).select("_x", "_y", "scene_id")))
    return p.hint("merge").join(met, ["_x", "_y"]).select(key, "scene_id")


def best_scene(samples: DataFrame, scenes: DataFrame, key: str = "sample_id",
               lon: str = "longitude", lat: str = "latitude", date: str = "sample_date",
               window_days: int = DEFAULT_WINDOW_DAYS, cell_deg: float = DEFAULT_CELL_DEG,
               bucket_days: int | None = None) -> DataFrame:
    """For each sample, the least cloudy scene whose footprint contains the
    point and whose acquisition time is in ``[date - w, date + w)``.

    Ties on cloud % go to the scene closest in time, then the lowest
    ``scene_id``.  Samples without a scene keep NULL scene columns.  Output:
    the sample columns + ``scene_id``, ``image_date``, ``cloud_pct``,
    ``acquired_at`` and the scene's raster origin ``scene_min_lon``/``scene_min_lat``.

    ``scenes`` needs: scene_id, min_lon, min_lat, max_lon, max_lat,
    acquired_at (timestamp), cloud_pct.  ``bucket_days``: the whole window unless
    given, so a sample meets two buckets.
    """
    tile, bucket = cell_deg * TILE_CELLS, bucket_days or max(2 * window_days, 1)
    sk = _scene_keys(scenes.select("scene_id", "min_lon", "min_lat", "max_lon", "max_lat",
                                   "acquired_at", "cloud_pct"), tile, bucket)
    smk = _sample_keys(samples.select(key, lon, lat, date), lon, lat, date, tile, window_days, bucket)
    start = F.col(date).cast("date").cast("timestamp_ntz")
    lo = F.date_sub(F.col(date).cast("date"), window_days).cast("timestamp_ntz")
    hi = F.date_add(F.col(date).cast("date"), window_days).cast("timestamp_ntz")
    at = F.col("acquired_at").cast("timestamp_ntz")
    # both sides grow with the data and the explodes hide their true size
    # from the static estimate: shuffle both (sort-merge, AQE splits hot tiles)
    cand = (smk.hint("merge").join(sk, ["_cx", "_cy", "_tb"], "inner")
            .where(contains(lon, lat) & (at >= lo) & (at < hi))
            .withColumn("_dt", F.abs(_seconds_between(start, at))))
    # min of a struct is a sort aggregate, partial before the shuffle; its first three fields decide
    best = (cand.groupBy(key)
            .agg(F.min(F.struct("cloud_pct", "_dt", "scene_id", "acquired_at", "min_lon", "min_lat")).alias("_b"))
            .select(key, "_b.scene_id", "_b.cloud_pct", "_b.acquired_at",
                    F.col("_b.min_lon").alias("scene_min_lon"), F.col("_b.min_lat").alias("scene_min_lat")))
    return (samples.join(best, key, "left")
            .withColumn("image_date", F.col("acquired_at").cast("date")))


def pixel_keys(df: DataFrame, x: str, y: str, res: float = 10.0) -> DataFrame:
    """Snap projected coordinates (metres) to the pixel grid of ``res`` metres."""
    return (df.withColumn("px", F.floor(F.col(x) / F.lit(res)).cast("long"))
            .withColumn("py", F.floor(F.col(y) / F.lit(res)).cast("long")))


def sample_pixels(points: DataFrame, pixels: DataFrame, x: str = "x_m", y: str = "y_m",
                  res: float = 10.0, bands=("B2", "B3", "B4", "B5", "B8", "B11")) -> DataFrame:
    """Band values of the pixel containing each point (left equi join on
    scene and snapped pixel indices; no pixel -> NULL bands)."""
    p = pixel_keys(points, x, y, res)
    return p.join(pixels.select("scene_id", "px", "py", *bands), ["scene_id", "px", "py"], "left")


def scene_pixel_keys(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                     res_deg: float = 0.12) -> DataFrame:
    """Pixel indices of a point in its scene's raster (origin at the
    footprint's min corner, square pixels of ``res_deg``)."""
    return (df.withColumn("px", F.floor((F.col(lon) - F.col("scene_min_lon")) / F.lit(res_deg)).cast("long"))
            .withColumn("py", F.floor((F.col(lat) - F.col("scene_min_lat")) / F.lit(res_deg)).cast("long")))
