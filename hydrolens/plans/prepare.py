"""Entry point A: field-data preparation and profiling.

long measurements → last-run pivot (D07) → fixed columns (B01) → station
coordinates: UTM inverse (F11) with hand overrides (C05) → left lookup onto
the samples (C01).  Profiles (D01, D03, B11) are aggregates on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import with_utm_inverse
from ..operators.clean import project
from ..operators.joins import lookup_left, override
from ..operators.profile import group_mean_count, iqr_outliers, missing_profile
from ..operators.reshape import pivot_last_run


def prepare_field_data(long: DataFrame, stations_utm: DataFrame, fixes: DataFrame, parameters,
                       keep_columns, keys=("point", "sample_date"), order="ord", zone: int = 22,
                       south: bool = True) -> DataFrame:
    """Wide, located samples ready for profiling and enrichment."""
    wide = pivot_last_run(long, list(keys), order, "parameter", "result", "unit", parameters)
    wide = project(wide, [*keys, *keep_columns])
    st = with_utm_inverse(stations_utm, "X", "Y", zone=zone, south=south, lat="latitude", lon="longitude")
    st = override(st.select("point", "latitude", "longitude"), fixes, "point", ["latitude", "longitude"])
    return lookup_left(wide, st, "point")


def profile(wide: DataFrame, key: str, value: str) -> dict[str, DataFrame]:
    """The three per-parameter reports: mean/count per station, missing-value
    profile, and IQR outliers (row key, station, date, value)."""
    return {
        "mean_per_point": group_mean_count(wide, key, value, mean_name="mean", count_name="n_samples"),
        "missing": missing_profile(wide),
        "outliers": iqr_outliers(wide.select(key, "sample_date", F.col(f"`{value}`").alias("value")), "value"),
    }
