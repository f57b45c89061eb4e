"""Entry point B: scene enrichment.

samples ⟕ best scene in ±w days (C02/C03) → band values of the pixel holding
the point (C04) → spectral indices with the all-or-nothing rule (F01-F04) →
Month/Season (F08/F09).  One lazy plan; the only shuffles are the
(cell, time-bucket) equi join, the per-sample ``min_by`` and the pixel join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_of, season_of_month
from ..functions.spectral import BANDS, ENRICH_COLUMNS, with_spectral_indices
from ..operators.scenes import best_scene, scene_pixel_keys
from . import standins as SI

PIXEL_DEG = 0.12
STANDIN_CELL_DEG = 0.06


def enrich(samples: DataFrame, scenes: DataFrame, pixels: DataFrame, window_days: int = 30,
           month_from: str = "image", res_deg: float = PIXEL_DEG, key: str = "sample_id",
           cell_deg: float = 0.25) -> DataFrame:
    """Attach the 15 enrichment columns and Month/Season to every sample.

    ``month_from``: 'image' (month of the image date) or 'sample' (month of
    the sample date); samples without an image keep NULL Month/Season when
    the month comes from the image.
    """
    b = best_scene(samples, scenes, key=key, window_days=window_days, cell_deg=cell_deg)
    b = scene_pixel_keys(b, res_deg=res_deg)
    j = b.join(pixels.select("scene_id", "px", "py", *BANDS), ["scene_id", "px", "py"], "left")
    j = j.withColumnRenamed("cloud_pct", "Cloud_Percentage").withColumnRenamed("image_date", "Image_Date")
    j = with_spectral_indices(j)
    src = "Image_Date" if month_from == "image" else "sample_date"
    out = (j.withColumn("Month", month_of(src)).withColumn("Season", season_of_month(F.col("Month"))))
    keep = [c for c in samples.columns] + ENRICH_COLUMNS + ["Month", "Season"]
    return out.select(*keep)


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in rasters: a 2×2 pixel grid per scene from the scene's line items."""
    li = SI.table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("scene_id"), (F.col("l_linenumber") % 2).cast("long").alias("px"),
                       (F.floor(F.col("l_linenumber") / 2) % 2).cast("long").alias("py"))
            .agg((F.lit(300.0) + F.sum("l_quantity") * 20).alias("B2"),
                 (F.lit(250.0) + F.sum(F.round(F.col("l_extendedprice"))) % 900).alias("B3"),
                 (F.lit(200.0) + F.sum(F.round(F.col("l_discount") * 100)) * 30).alias("B4"),
                 (F.lit(150.0) + F.sum(F.round(F.col("l_tax") * 100)) * 25).alias("B5"),
                 (F.lit(100.0) + F.count(F.lit(1)) * 400).cast("double").alias("B8"),
                 (F.lit(80.0) + F.max("l_quantity") * 12).alias("B11")))


def enrichment_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query on the benchmark tables."""
    # stand-in footprints are 0.24° wide: cells of 0.06° (a quarter of that)
    return enrich(SI.scene_samples(spark, sf_dir), SI.scenes(spark, sf_dir), scene_pixels(spark, sf_dir),
                  cell_deg=STANDIN_CELL_DEG)
