"""Scalar functions: all-or-nothing indices, dates, numbers, slugs, units."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hydrolens.functions.dates import epoch_millis_to_date, parse_date_multi, season_of_month
from hydrolens.functions.numeric import to_double_lenient
from hydrolens.functions.spectral import ENRICH_COLUMNS, raw_estimator, with_spectral_indices
from hydrolens.functions.text import slug, slug_py, unit_of


def _bands(spark, rows):
    return spark.createDataFrame(rows, "id int, B2 double, B3 double, B4 double, B5 double, B8 double, B11 double, "
                                       "Image_Date date, Cloud_Percentage double")


def test_all_or_nothing(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, 600.0, 700.0, 650.0, 680.0, 620.0, 500.0, d, 3.0),
            (2, 600.0, 700.0, 0.0, 0.0, 620.0, 500.0, d, 3.0),     # B5 + B4 = 0 -> all NULL
            (3, 600.0, None, 650.0, 680.0, 620.0, 500.0, d, 3.0)]  # missing band -> all NULL
    out = {r["id"]: r for r in with_spectral_indices(_bands(spark, rows)).collect()}
    assert out[1]["NDCI"] == pytest.approx((680 - 650) / (680 + 650))
    assert out[1]["FAI"] == pytest.approx(620 - (650 + (500 - 650) * (833 - 665) / (1610 - 665)))
    for i in (2, 3):
        assert all(out[i][c] is None for c in ENRICH_COLUMNS), i


def test_raw_estimators(spark):
    df = _bands(spark, [(1, 600.0, 700.0, 650.0, 680.0, 620.0, 500.0, None, None)])
    r = df.select(*[raw_estimator(p).alias(str(i)) for i, p in enumerate(
        ["Clorofila a", "Turbidez", "Transparência da Água", "Sólidos Dissolvidos Totais"])]).first()
    assert r["0"] == pytest.approx((1 / 700 - 1 / 650) * 620)
    assert r["1"] == pytest.approx((650 - 700) / (650 + 700)) == r["3"]
    assert r["2"] == pytest.approx(600 / 650)
    with pytest.raises(ValueError):
        raw_estimator("pH")


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("05/01/2024", "2,14", 1704412800000), ("2024-01-05", "0004.46", 0),
                                ("junk", "n/a", None)], "d string, x string, ms long")
    r = df.select(parse_date_multi("d").alias("d"), to_double_lenient("x").alias("x"),
                  epoch_millis_to_date("ms").alias("e")).collect()
    assert [x["d"] for x in r] == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None]
    assert [x["x"] for x in r] == [2.14, 4.46, None]
    assert r[0]["e"] == dt.date(2024, 1, 5) and r[1]["e"] == dt.date(1970, 1, 1)


def test_season_slug_unit(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    seasons = [r[0] for r in df.select(season_of_month(F.col("m"))).collect()]
    assert seasons == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1]
    t = spark.createDataFrame([("Clorofila a",), ("Transparência da Água",), ("pH",)], "p string")
    got = t.select(slug("p").alias("s"), unit_of("p").alias("u")).collect()
    assert [g["s"] for g in got] == [slug_py(x) for x in ("Clorofila a", "Transparência da Água", "pH")]
    assert [g["u"] for g in got] == ["μg/L", "m", None]
