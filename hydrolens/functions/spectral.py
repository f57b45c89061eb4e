"""Spectral indices of Sentinel-2 surface reflectance bands.

All functions return Columns; division by zero gives NULL (``try_divide``)
instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands sampled at each point, the derived index columns and
# the temporal features, in the order the training tables use them.
BANDS = ["B2", "B3", "B4", "B5", "B8", "B11"]
INDEX_COLUMNS = ["NDCI", "NDVI", "FAI", "MNDWI", "B3_B2_ratio", "B4_B3_ratio", "B5_B4_ratio"]
TEMPORAL_COLUMNS = ["Month", "Season"]
FEATURE_COLUMNS = BANDS + INDEX_COLUMNS + TEMPORAL_COLUMNS
# Sentinel-2 central wavelengths (nm) used by the floating algae index.
FAI_RED_NM, FAI_NIR_NM, FAI_SWIR_NM = 665, 833, 1610
ENRICH_COLUMNS = BANDS + INDEX_COLUMNS + ["Image_Date", "Cloud_Percentage"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized_difference(a, b) -> Column:
    """(a - b) / (a + b)."""
    a, b = _c(a), _c(b)
    return F.try_divide(a - b, a + b)


def floating_algae_index(b4="B4", b8="B8", b11="B11") -> Column:
    """FAI = B8 - (B4 + (B11 - B4) * (833 - 665) / (1610 - 665))."""
    b4, b8, b11 = _c(b4), _c(b8), _c(b11)
    k = (FAI_NIR_NM - FAI_RED_NM) / (FAI_SWIR_NM - FAI_RED_NM)
    return b8 - (b4 + (b11 - b4) * F.lit(k))


def index_expressions() -> dict[str, Column]:
    """The seven index columns computed from the band columns B2..B11."""
    return {
        "NDCI": normalized_difference("B5", "B4"),
        "NDVI": normalized_difference("B8", "B4"),
        "FAI": floating_algae_index(),
        "MNDWI": normalized_difference("B3", "B11"),
        "B3_B2_ratio": F.try_divide(F.col("B3"), F.col("B2")),
        "B4_B3_ratio": F.try_divide(F.col("B4"), F.col("B3")),
        "B5_B4_ratio": F.try_divide(F.col("B5"), F.col("B4")),
    }


def indices_valid() -> Column:
    """True when every band is present and no index divisor is zero."""
    b = {n: F.col(n) for n in BANDS}
    ok = None
    for n in BANDS:
        t = b[n].isNotNull()
        ok = t if ok is None else ok & t
    for d in (b["B5"] + b["B4"], b["B8"] + b["B4"], b["B3"] + b["B11"], b["B2"], b["B3"], b["B4"]):
        ok = ok & (d != 0)
    return F.coalesce(ok, F.lit(False))


def with_spectral_indices(df, image_date="Image_Date", cloud="Cloud_Percentage"):
    """Add the 7 indices with the all-or-nothing rule.

    If any band is missing or any divisor is zero, all 15 enrichment columns
    (6 bands, 7 indices, image date, cloud %) become NULL together -- a failed
    sample is a failed sample, not a half-filled row.
    """
    ok = indices_valid()
    cols = {**{n: F.col(n).cast("double") for n in BANDS}, **index_expressions()}
    out = {n: F.when(ok, e) for n, e in cols.items()}
    out["Image_Date"] = F.when(ok, F.col(image_date))
    out["Cloud_Percentage"] = F.when(ok, F.col(cloud).cast("double"))
    keep = [c for c in df.columns if c not in set(out) | {image_date, cloud}]
    return df.select(*keep, *[e.alias(n) for n, e in out.items()])


def engineered_features(df):
    """Tuner features: B4/(B5+1e-4), B3/(B5+1e-4) when B3, B4, B5 exist;
    NDCI^2 and MNDWI^2 when those exist."""
    cols = set(df.columns)
    add = {}
    if {"B3", "B4", "B5"} <= cols:
        add["B4_B5_ratio"] = F.try_divide(F.col("B4"), F.col("B5") + F.lit(0.0001))
        add["B3_B5_ratio"] = F.try_divide(F.col("B3"), F.col("B5") + F.lit(0.0001))
    if "NDCI" in cols:
        add["NDCI_squared"] = F.col("NDCI") * F.col("NDCI")
    if "MNDWI" in cols:
        add["MNDWI_squared"] = F.col("MNDWI") * F.col("MNDWI")
    return df.withColumns(add) if add else df


# Closed-form (uncalibrated) estimator for each parameter.
def raw_estimator(parameter: str) -> Column:
    """Closed-form index used as a physical estimator of ``parameter``.

    Clorofila a: (1/B3 - 1/B4) * B8; Turbidez and Sólidos Dissolvidos Totais:
    (B4 - B3) / (B4 + B3); Transparência da Água: B2 / B4.  Unknown -> ValueError.
    """
    b2, b3, b4, b8 = (F.col(n) for n in ("B2", "B3", "B4", "B8"))
    if parameter == "Clorofila a":
        return (F.try_divide(F.lit(1.0), b3) - F.try_divide(F.lit(1.0), b4)) * b8
    if parameter in ("Turbidez", "Sólidos Dissolvidos Totais"):
        return normalized_difference(b4, b3)
    if parameter == "Transparência da Água":
        return F.try_divide(b2, b4)
    raise ValueError(f"Unknown parameter: {parameter}")


RAW_ESTIMATOR_PARAMETERS = ["Clorofila a", "Turbidez", "Transparência da Água", "Sólidos Dissolvidos Totais"]


def raw_estimator_by_name(param_col) -> Column:
    """Row-wise version: the estimator chosen by a parameter-name column
    (NULL for unknown names)."""
    p = _c(param_col)
    e = None
    for name in RAW_ESTIMATOR_PARAMETERS:
        e = (F.when(p == name, raw_estimator(name)) if e is None
             else e.when(p == name, raw_estimator(name)))
    return e


def calibrated(raw, slope, intercept) -> Column:
    """slope * raw + intercept; the raw index when no calibration exists."""
    raw = _c(raw)
    return F.coalesce(_c(slope) * raw + _c(intercept), raw)
