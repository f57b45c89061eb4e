"""Stand-in inputs built from the benchmark tables.

Each function only reshapes a benchmark table into the schema a job expects
(renames, unit-free arithmetic, injected NULLs, text formatting).  None of
them does any of the job's work; every job must be right on any data of the
same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_of, season_of_month
from ..functions.spectral import with_spectral_indices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_when(cond, c):
    return F.when(cond, F.lit(None)).otherwise(c)


def samples(spark, sf_dir) -> DataFrame:
    """Wide field samples: one row per order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("sample_id"),
        F.concat(F.lit("P"), F.lpad((F.col("o_custkey") % 25).cast("string"), 2, "0")).alias("point"),
        F.col("o_orderdate").cast("date").alias("sample_date"),
        _null_when(k % 7 == 0, F.col("o_totalprice") / F.lit(1000.0)).cast("double").alias("turbidity"),
        _null_when(k % 11 == 0, (F.col("o_totalprice") % 1000) / F.lit(100.0)).cast("double").alias("chlorophyll"),
        _null_when(k % 13 == 0, F.col("o_totalprice") % 100).cast("double").alias("cloud_pct"),
        ((F.col("o_custkey") % 200).cast("double") - F.lit(100.0)).alias("latitude"),
        ((k % 400).cast("double") - F.lit(200.0)).alias("longitude"))


def dirty_text(spark, sf_dir) -> DataFrame:
    """Text-typed samples: day-first or ISO dates, decimal commas, junk."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("date")
    date_txt = (F.when(k % 17 == 0, F.concat(F.lit("n/d "), k.cast("string")))
                .when(k % 2 == 0, F.date_format(d, "dd/MM/yyyy"))
                .otherwise(F.date_format(d, "yyyy-MM-dd")))
    num = F.col("o_totalprice").cast("string")
    val_txt = (F.when(k % 19 == 0, F.lit("n/a"))
               .when(k % 3 == 0, F.replace(num, F.lit("."), F.lit(",")))
               .otherwise(num))
    return o.select(k.alias("sample_id"), date_txt.alias("date_text"), val_txt.alias("value_text"))


def field_lines(spark, sf_dir) -> DataFrame:
    """Lines of a field file: key, date, value and place, some of them broken."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    d = dirty_text(spark, sf_dir)
    k = F.col("sample_id")
    j = d.join(o, k == F.col("o_orderkey"))
    lat = ((F.col("o_custkey") % 200) - 100).cast("string")
    whole = F.concat_ws(";", k.cast("string"), "date_text", "value_text", lat, (k % 400 - 200).cast("string"))
    return j.select(F.when(k % 23 == 0, F.concat_ws(";", k.cast("string"), "date_text"))
                    .when(k % 29 == 0, F.concat(whole, F.lit(";more")))
                    .when(k % 31 == 0, F.concat(F.lit("x"), whole)).otherwise(whole).alias("value"))


def measurements(spark, sf_dir) -> DataFrame:
    """Long measurements (point, date, parameter, result, unit) in file order ``ord``."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("U"), (F.col("user_id") % 4).cast("string")).alias("point"),
        F.col("ts").cast("date").alias("sample_date"),
        F.col("event_type").alias("parameter"),
        F.col("value").alias("result"),
        _null_when(F.col("event_id") % 5 == 0, F.upper(F.substring("event_type", 1, 1))).alias("unit"))


def predictions(spark, sf_dir) -> DataFrame:
    """Model outputs: (model, sample_id, actual, predicted); some rows name no
    model."""
    e = table(spark, sf_dir, "events")
    return e.select(_null_when(F.col("event_id") % 97 == 0, F.col("event_type")).alias("model"), F.col("event_id").alias("sample_id"),
                    F.col("value").alias("actual"),
                    (F.col("value") * F.lit(0.8) + (F.col("user_id") % 13).cast("double")).alias("predicted"))


def importances(spark, sf_dir) -> DataFrame:
    """Feature importance per model: (model, feature, importance)."""
    li = table(spark, sf_dir, "lineitem")
    feat = F.concat(F.lit("F"), F.lpad((F.col("l_partkey") % 19).cast("string"), 2, "0"))
    return (li.groupBy(F.col("l_returnflag").alias("model"), feat.alias("feature"))
            .agg((F.sum("l_quantity") / F.count(F.lit(1)) - F.lit(25.5)).alias("importance")))


def bands(spark, sf_dir) -> DataFrame:
    """Per-sample reflectance of six bands (integer-valued doubles)."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.sum(F.round(F.col("l_extendedprice"))).alias("p"), F.sum("l_quantity").alias("q"),
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_discount") * 100)).alias("d"),
        F.sum(F.round(F.col("l_tax") * 100)).alias("t"), F.max("l_linenumber").alias("ln"))
    return g.select(
        "sample_id",
        (F.lit(300.0) + F.col("p") % 700).alias("B2"),
        (F.lit(200.0) + F.col("q") * 10).alias("B3"),
        (F.col("d") * 20).cast("double").alias("B4"),
        (F.lit(100.0) + F.col("t") * 15).alias("B5"),
        (F.lit(150.0) + F.col("n") * 90).cast("double").alias("B8"),
        _null_when(F.col("sample_id") % 17 == 0, F.lit(50.0) + F.col("ln") * 40).cast("double").alias("B11"))


def training_rows(spark, sf_dir) -> DataFrame:
    """Enriched training rows: samples + bands + indices + Month/Season."""
    s = samples(spark, sf_dir).withColumnRenamed("cloud_pct", "Cloud_Percentage") \
                              .withColumn("Image_Date", F.col("sample_date"))
    j = s.join(bands(spark, sf_dir), "sample_id", "left")
    j = with_spectral_indices(j)
    return (j.withColumn("Month", month_of("sample_date"))
            .withColumn("Season", season_of_month(F.col("Month"))))


def scene_samples(spark, sf_dir) -> DataFrame:
    """Sample points for scene matching: one per order at its customer's
    station.  Stations sit on a 0.05° lattice, 40 columns wide, one row per
    40 customers, so the area grows with the data and the density of
    scenes per station stays realistic at every scale."""
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("sample_id"),
                    F.col("o_orderdate").cast("date").alias("sample_date"),
                    (F.lit(-52.0) + (c % 40).cast("double") * F.lit(0.05)).alias("longitude"),
                    (F.lit(-19.0) + F.floor(c / 40).cast("double") * F.lit(0.05)).alias("latitude"))


def scenes(spark, sf_dir) -> DataFrame:
    """Scene catalogue: footprint box (0.24° square), acquisition time,
    cloud %.  Centres cover the same lattice as the stations (ten orders
    per customer, so ten scenes per lattice point over the whole period)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cx = F.lit(-52.0) + (k % 40).cast("double") * F.lit(0.05)
    cy = F.lit(-19.0) + F.floor(k / 400).cast("double") * F.lit(0.05)
    h = F.lit(0.12)
    return o.select(k.alias("scene_id"), (cx - h).alias("min_lon"), (cy - h).alias("min_lat"),
                    (cx + h).alias("max_lon"), (cy + h).alias("max_lat"),
                    (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("acquired_at"),
                    (F.col("o_totalprice") % 100).alias("cloud_pct"))


def scene_footprints(spark, sf_dir) -> DataFrame:
    """Scene outlines as tilted squares: (scene_id, ring of lon/lat points)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cx = F.lit(-52.0) + (k % 40).cast("double") * F.lit(0.05)
    cy = F.lit(-19.0) + F.floor(k / 400).cast("double") * F.lit(0.05)
    a, b = 0.117, 0.061
    corners = [(-a, -b), (b, -a), (a, b), (-b, a)]
    return o.select(k.alias("scene_id"), F.array(*[F.struct((cx + x).alias("lon"), (cy + y).alias("lat"))
                                                   for x, y in corners]).alias("ring"))


def pixel_points(spark, sf_dir) -> DataFrame:
    """Points in projected metres on a scene."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 50).alias("scene_id"),
                    ((F.col("o_orderkey") % 1000).cast("double") + F.lit(0.5)).alias("x_m"),
                    (F.col("o_totalprice") % 70).alias("y_m"))


def pixels(spark, sf_dir) -> DataFrame:
    """Pixel rasters as rows: (scene_id, px, py, B2..B11)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy((F.col("l_suppkey") % 50).alias("scene_id"), (F.col("l_partkey") % 100).alias("px"),
                       F.col("l_linenumber").cast("long").alias("py"))
            .agg(F.sum("l_quantity").alias("B2"), F.count(F.lit(1)).cast("double").alias("B3"),
                 F.max("l_quantity").alias("B4"), F.min("l_quantity").alias("B5"),
                 F.sum(F.round(F.col("l_tax") * 100)).alias("B8"),
                 F.sum(F.round(F.col("l_discount") * 100)).alias("B11")))


def utm_points(spark, sf_dir) -> DataFrame:
    """Stations in UTM zone 22 south (metres)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("station_id"),
                    (F.lit(400000) + (F.col("p_partkey") % 2000) * 100).cast("double").alias("X"),
                    (F.lit(7900000) + F.col("p_partkey") * 5).cast("double").alias("Y"))


def stations(spark, sf_dir) -> DataFrame:
    """Stations with coordinates (from suppliers)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("point"),
                    (F.lit(-18.0) - F.col("s_acctbal") / F.lit(10000.0)).alias("latitude"),
                    (F.lit(-51.0) - F.col("s_nationkey").cast("double") / F.lit(100.0)).alias("longitude"))


def station_fixes(spark, sf_dir) -> DataFrame:
    """Hand corrections for some stations."""
    s = table(spark, sf_dir, "supplier")
    return (s.where(F.col("s_suppkey") % 3 == 0)
            .select(F.col("s_name").alias("point"),
                    (F.lit(-18.5) + F.col("s_suppkey").cast("double") / F.lit(1000.0)).alias("latitude"),
                    (F.lit(-51.5) + F.col("s_suppkey").cast("double") / F.lit(1000.0)).alias("longitude")))


def field_sources(spark, sf_dir) -> dict[str, DataFrame]:
    """Five field sources with their own column spellings, the last one in the
    long layout (a row per measurement)."""
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    p = table(spark, sf_dir, "part")
    o = table(spark, sf_dir, "orders")
    e = table(spark, sf_dir, "events")
    return {
        "cemig_turbidity": c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("Sitio_cord"),
                                    F.col("c_acctbal").alias("Turbidez"),
                                    F.col("c_nationkey").cast("double").alias("Latitude"),
                                    (-F.col("c_nationkey")).cast("double").alias("Longitude")),
        "cemig_both": s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ponto"),
                               F.col("s_acctbal").cast("string").alias("Clorofila_a"),
                               F.col("s_nationkey").cast("double").alias("Turbidez")),
        "codevasf": p.select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("Ponto_de_coleta"),
                             F.col("p_retailprice").alias("Clorofila_a_(µg_l)"),
                             F.lit(-18.2).alias("Latitude"), F.lit(-45.1).alias("Longitude")),
        "guaicuy": o.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("Object_ID"),
                            F.when(F.col("o_orderkey") % 2 == 0,
                                   F.date_format(F.col("o_orderdate"), "dd/MM/yyyy"))
                            .otherwise(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")).alias("Data"),
                            F.replace((F.col("o_totalprice") / F.lit(1000.0)).cast("string"),
                                      F.lit("."), F.lit(",")).alias("Turbidez")),
        "long": e.select(F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("sitio_cod"),
                         F.date_format(F.col("ts").cast("date"), "d/M/yyyy").alias("data"),
                         F.when(F.col("event_id") % 3 == 0, "Turbidez").when(F.col("event_id") % 3 == 1, "Clorofila a")
                         .otherwise("pH").alias("paramet"), F.lit("x").alias("unidade"),
                         F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")).alias("result")),
    }


def parameter_rows(spark, sf_dir) -> DataFrame:
    """Rows naming a water-quality parameter (and one unknown name)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    name = (F.when(k == 0, "Clorofila a").when(k == 1, "Turbidez").when(k == 2, "Transparência da Água")
            .when(k == 3, "Sólidos Dissolvidos Totais").otherwise("pH"))
    return o.select(F.col("o_orderkey").alias("sample_id"), name.alias("parameter"))


def categories(spark, sf_dir) -> DataFrame:
    """A text category with gaps."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sample_id"),
                    _null_when(F.col("o_orderkey") % 9 == 0, F.col("o_orderpriority")).alias("category"))
