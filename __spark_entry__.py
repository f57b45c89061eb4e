"""

Each query runs one operator of the inventory over whole benchmark tables
(reshaped by ``hydrolens.plans.standins``); the oracle SQL restates the same
stand-in input and the operator's semantics in plain SQL for DuckDB.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# importable however this file is loaded (by path, from another working directory)
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from hydrolens.functions.geo import utm_inverse_steps  # noqa: E402
from hydrolens.plans import catalog as Q  # noqa: E402

LLM = PIPELINE = None  # the training-text operators are optional
try:
    from hydrolens.llm import queries as LLM  # noqa: E402
    import corpus_pipeline as PIPELINE  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("hydrolens.llm", "corpus_pipeline"):
        raise

SF_SMOKE = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: best scene per field sample + spectral indices + season
    (the enrichment job) on sf0.001."""
    from hydrolens.plans.enrich import enrichment_job
    return enrichment_job(spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name[2:]: fn for name, fn in vars(Q).items() if name.startswith("q_") and callable(fn)}
    if LLM is not None:
        found |= LLM.QUERIES
    if PIPELINE is not None:
        found["pipeline"] = PIPELINE.run
    return found


# ---------------------------------------------------------------------------------------------
# Oracle SQL.  Stand-in CTEs first (same reshaping as hydrolens.plans.standins).
# ---------------------------------------------------------------------------------------------
def _r(*cols, scale=6):
    return ", ".join(f"round({c}, {scale}) AS {c}" for c in cols)


SAMPLES = """samples AS (
  SELECT o_orderkey AS sample_id,
         'P' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS point,
         CAST(o_orderdate AS DATE) AS sample_date,
         CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 1000e0 END AS DOUBLE) AS turbidity,
         CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_totalprice % 1000) / 100e0 END AS DOUBLE) AS chlorophyll,
         CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice % 100 END AS DOUBLE) AS cloud_pct,
         CAST(o_custkey % 200 AS DOUBLE) - 100e0 AS latitude,
         CAST(o_orderkey % 400 AS DOUBLE) - 200e0 AS longitude
  FROM orders)"""
SAMPLE_COLS = "sample_id, point, sample_date, " + _r("turbidity", "chlorophyll", "cloud_pct", "latitude", "longitude")

PRED = """pred AS (
  SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END AS model, event_id AS sample_id, value AS actual,
         value * 0.8e0 + CAST(user_id % 13 AS DOUBLE) AS predicted FROM events)"""

METRICS = PRED + """,
mraw AS (SELECT model, count(*) AS n, sum((predicted - actual) * (predicted - actual)) AS sse,
                sum(abs(predicted - actual)) AS sae, var_pop(actual) AS v FROM pred GROUP BY model),
mm AS (SELECT model, n, sqrt(sse / n) AS rmse, sae / n AS mae,
              CASE WHEN n * v = 0 THEN CASE WHEN sse = 0 THEN 1e0 ELSE 0e0 END ELSE 1 - sse / (n * v) END AS r2
       FROM mraw)"""

MEAS = """meas AS (
  SELECT event_id AS ord, 'U' || CAST(user_id % 4 AS VARCHAR) AS point, CAST(ts AS DATE) AS sample_date,
         event_type AS parameter, value AS result,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE upper(substr(event_type, 1, 1)) END AS unit
  FROM events)"""

IMP = """imp AS (
  SELECT l_returnflag AS model, 'F' || lpad(CAST(l_partkey % 19 AS VARCHAR), 2, '0') AS feature,
         sum(l_quantity) / count(*) - 25.5e0 AS importance
  FROM lineitem GROUP BY ALL)"""

BANDS = """bands AS (
  SELECT l_orderkey AS sample_id,
         300e0 + sum(round(l_extendedprice)) % 700 AS B2,
         200e0 + sum(l_quantity) * 10 AS B3,
         CAST(sum(round(l_discount * 100)) * 20 AS DOUBLE) AS B4,
         100e0 + sum(round(l_tax * 100)) * 15 AS B5,
         CAST(150e0 + count(*) * 90 AS DOUBLE) AS B8,
         CAST(CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 50e0 + max(l_linenumber) * 40 END AS DOUBLE) AS B11
  FROM lineitem GROUP BY l_orderkey)"""

FAI_K = "(168e0 / 945e0)"
TRAIN = SAMPLES + ",\n" + BANDS + f""",
tj AS (SELECT s.*, b.B2, b.B3, b.B4, b.B5, b.B8, b.B11 FROM samples s LEFT JOIN bands b USING (sample_id)),
tok AS (SELECT *, coalesce(B2 IS NOT NULL AND B3 IS NOT NULL AND B4 IS NOT NULL AND B5 IS NOT NULL
                           AND B8 IS NOT NULL AND B11 IS NOT NULL AND (B5 + B4) <> 0 AND (B8 + B4) <> 0
                           AND (B3 + B11) <> 0 AND B2 <> 0 AND B3 <> 0 AND B4 <> 0, false) AS ok FROM tj),
train AS (
  SELECT sample_id, point, sample_date, turbidity, chlorophyll, latitude, longitude,
         CASE WHEN ok THEN B2 END AS B2, CASE WHEN ok THEN B3 END AS B3, CASE WHEN ok THEN B4 END AS B4,
         CASE WHEN ok THEN B5 END AS B5, CASE WHEN ok THEN B8 END AS B8, CASE WHEN ok THEN B11 END AS B11,
         CASE WHEN ok THEN (B5 - B4) / (B5 + B4) END AS NDCI,
         CASE WHEN ok THEN (B8 - B4) / (B8 + B4) END AS NDVI,
         CASE WHEN ok THEN B8 - (B4 + (B11 - B4) * {FAI_K}) END AS FAI,
         CASE WHEN ok THEN (B3 - B11) / (B3 + B11) END AS MNDWI,
         CASE WHEN ok THEN B3 / B2 END AS B3_B2_ratio,
         CASE WHEN ok THEN B4 / B3 END AS B4_B3_ratio,
         CASE WHEN ok THEN B5 / B4 END AS B5_B4_ratio,
         CASE WHEN ok THEN sample_date END AS Image_Date,
         CASE WHEN ok THEN cloud_pct END AS Cloud_Percentage,
         CAST(month(sample_date) AS INTEGER) AS Month,
         CAST(floor((month(sample_date) % 12 + 3) / 3) AS INTEGER) AS Season
  FROM tok)"""

DIRTY = """dirty AS (
  SELECT o_orderkey AS sample_id,
         CASE WHEN o_orderkey % 17 = 0 THEN 'n/d ' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderkey % 2 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')
              ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS date_text,
         CASE WHEN o_orderkey % 19 = 0 THEN 'n/a'
              WHEN o_orderkey % 3 = 0 THEN replace(CAST(o_totalprice AS VARCHAR), '.', ',')
              ELSE CAST(o_totalprice AS VARCHAR) END AS value_text
  FROM orders)"""
PARSE_DATE = ("coalesce(CAST(try_strptime(trim(date_text), '%d/%m/%Y') AS DATE), "
              "CAST(try_strptime(trim(date_text), '%Y-%m-%d') AS DATE))")
PARSE_NUM = "TRY_CAST(replace(trim(value_text), ',', '.') AS DOUBLE)"

PARAMS = """params AS (
  SELECT o_orderkey AS sample_id,
         CASE o_orderkey % 5 WHEN 0 THEN 'Clorofila a' WHEN 1 THEN 'Turbidez'
              WHEN 2 THEN 'Transparência da Água' WHEN 3 THEN 'Sólidos Dissolvidos Totais' ELSE 'pH' END AS parameter
  FROM orders)"""

RAW_BY_NAME = """CASE parameter
      WHEN 'Clorofila a' THEN (1e0 / NULLIF(B3, 0) - 1e0 / NULLIF(B4, 0)) * B8
      WHEN 'Turbidez' THEN (B4 - B3) / NULLIF(B4 + B3, 0)
      WHEN 'Sólidos Dissolvidos Totais' THEN (B4 - B3) / NULLIF(B4 + B3, 0)
      WHEN 'Transparência da Água' THEN B2 / NULLIF(B4, 0) END"""

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _iqr(src: str, col: str) -> str:
    return (f"SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3, "
            f"quantile_cont({col}, 0.25) - 1.5 * (quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25)) AS lo, "
            f"quantile_cont({col}, 0.75) + 1.5 * (quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25)) AS hi "
            f"FROM {src}")


def _utm_sql() -> str:
    steps = utm_inverse_steps("X", "Y", 22, True)
    inner = ("SELECT p_partkey AS station_id, CAST(400000 + (p_partkey % 2000) * 100 AS DOUBLE) AS X, "
             "CAST(7900000 + p_partkey * 5 AS DOUBLE) AS Y FROM part")
    for name, sql in steps:
        inner = f"SELECT *, {sql} AS {name} FROM ({inner})"
    return f"SELECT station_id, round(_u_lat, 8) AS latitude, round(_u_lon, 8) AS longitude FROM ({inner})"


def _pivot_last_run_sql() -> str:
    cols = []
    for p in EVENT_TYPES:
        o = f"CASE WHEN parameter = '{p}' THEN ord END"
        cols.append(f"round(arg_max_null(CASE WHEN parameter = '{p}' THEN result END, {o}), 6) AS {p}")
        cols.append(f"arg_max_null(CASE WHEN parameter = '{p}' THEN unit END, {o}) AS {p}_UN")
    return f"""WITH {MEAS},
l AS (SELECT *, (lag(point) OVER w IS DISTINCT FROM point OR lag(sample_date) OVER w IS DISTINCT FROM sample_date) AS st
      FROM meas WINDOW w AS (ORDER BY ord)),
ls AS (SELECT point, sample_date, max(ord) AS last_start FROM l WHERE st GROUP BY ALL),
r AS (SELECT m.* FROM meas m JOIN ls USING (point, sample_date) WHERE m.ord >= ls.last_start)
SELECT point, sample_date, {", ".join(cols)} FROM r GROUP BY ALL"""


def _missing_sql() -> str:
    cols = [("sample_id", False), ("point", False), ("sample_date", False), ("turbidity", True),
            ("chlorophyll", True), ("cloud_pct", True), ("latitude", True), ("longitude", True)]
    parts = []
    for i, (c, num) in enumerate(cols):
        cond = f"{c} IS NULL OR isnan({c})" if num else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS \"column\", {i} AS pos, count(*) FILTER (WHERE {cond}) AS missing, "
                     f"count(*) AS n FROM samples")
    u = " UNION ALL ".join(parts)
    return (f"WITH {SAMPLES}, u AS ({u}) SELECT \"column\", pos, missing, "
            f"round(round_even(CAST(missing AS DOUBLE) * 100e0 / n, 2), 6) AS pct_missing FROM u")


def _missing_log_sql() -> str:
    feats = ["B2", "B3", "B4", "B5", "B8", "B11", "NDCI", "NDVI", "FAI", "MNDWI", "B3_B2_ratio",
             "B4_B3_ratio", "B5_B4_ratio", "Month", "Season"]
    ints = {"Month", "Season"}
    parts = []
    for i, c in enumerate(feats):
        cond = f"{c} IS NULL" if c in ints else f"{c} IS NULL OR isnan({c})"
        parts.append(f"SELECT '{c}' AS \"column\", {i} AS pos, count(*) FILTER (WHERE {cond}) AS missing, "
                     f"count(*) AS n FROM train")
    return (f"WITH {TRAIN}, u AS ({' UNION ALL '.join(parts)}) SELECT \"column\", pos, missing, "
            "round(round_even(CAST(missing AS DOUBLE) * 100e0 / n, 1), 6) AS pct_missing FROM u WHERE missing > 0")


def _funnel_sql() -> str:
    return f"""WITH {SAMPLES},
pre AS (SELECT * FROM samples WHERE cloud_pct <= 20 AND turbidity IS NOT NULL),
f AS ({_iqr('pre', 'turbidity')}),
c AS (SELECT count(*) AS c0,
             count(*) FILTER (WHERE cloud_pct <= 20) AS c1,
             count(*) FILTER (WHERE cloud_pct <= 20 AND turbidity IS NOT NULL) AS c2,
             count(*) FILTER (WHERE cloud_pct <= 20 AND turbidity IS NOT NULL
                              AND turbidity BETWEEN f.lo AND f.hi) AS c3
      FROM samples, f),
s AS (SELECT 1 AS step_no, 'cloud_pct <= 20' AS step, c0 AS rows_before, c1 AS rows_after FROM c
      UNION ALL SELECT 2, 'turbidity not null', c1, c2 FROM c
      UNION ALL SELECT 3, 'turbidity inside IQR fences', c2, c3 FROM c)
SELECT step_no, step, rows_before, rows_after, rows_before - rows_after AS removed,
       round(CAST(rows_before - rows_after AS DOUBLE) * 100e0 / NULLIF(rows_before, 0), 6) AS pct_removed FROM s"""


def _kde_sql() -> str:
    return f"""WITH r AS (SELECT (value * 0.8e0 + CAST(user_id % 13 AS DOUBLE)) - value AS residual FROM events),
s AS (SELECT count(residual) AS n, min(residual) AS mn, max(residual) AS mx, stddev_samp(residual) AS sd FROM r),
p AS (SELECT n, mn, mx, sd * pow(n, -0.2) AS h FROM s),
g AS (SELECT i, (mn - 3e0 * h) + i * ((mx + 3e0 * h) - (mn - 3e0 * h)) / 199e0 AS x, h, n
      FROM p, range(200) t(i))
SELECT CAST(i AS INTEGER) AS i, round(x, 6) AS x,
       round(sum(exp(-0.5e0 * pow((x - residual) / h, 2))) * (1e0 / (n * h * sqrt(2e0 * pi()))) * 1e6, 6) AS density_e6
FROM g, r GROUP BY i, x, h, n"""


def _hist_sql() -> str:
    return """WITH r AS (SELECT (value * 0.8e0 + CAST(user_id % 13 AS DOUBLE)) - value AS residual FROM events),
s AS (SELECT min(residual) AS mn, max(residual) AS mx FROM r),
w AS (SELECT mn, CASE WHEN mx > mn THEN (mx - mn) / 30e0 ELSE 1e0 END AS width FROM s),
b AS (SELECT CAST(least(floor((residual - mn) / width), 29) AS INTEGER) AS bin, mn, width FROM r, w),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(i AS INTEGER) AS bin, round(mn + i * width, 6) AS bin_start, round(mn + (i + 1) * width, 6) AS bin_end,
       coalesce(n, 0) AS count FROM range(30) r(i) JOIN w ON true LEFT JOIN c ON bin = i"""


def oracle_sql() -> dict[str, str]:
    s = {}
    # -- projections / filters
    s["project_cols"] = f"WITH {SAMPLES} SELECT sample_id, point, sample_date, turbidity FROM samples"
    s["threshold_filter"] = f"WITH {SAMPLES} SELECT {SAMPLE_COLS} FROM samples WHERE cloud_pct <= 10"
    s["drop_null_any"] = f"WITH {SAMPLES} SELECT {SAMPLE_COLS} FROM samples WHERE turbidity IS NOT NULL"
    s["drop_null_all"] = (f"WITH {SAMPLES} SELECT {SAMPLE_COLS} FROM samples WHERE NOT "
                          "(turbidity IS NULL AND chlorophyll IS NULL AND cloud_pct IS NULL)")
    s["geo_range"] = (f"WITH {SAMPLES} SELECT sample_id, {_r('latitude', 'longitude')} FROM samples "
                      "WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
    s["iqr_keep"] = (f"WITH f AS ({_iqr('events', 'value')}) SELECT event_id, event_type, round(value, 6) AS value "
                     "FROM events, f WHERE value BETWEEN f.lo AND f.hi")
    s["iqr_outliers"] = (f"WITH f AS ({_iqr('events', 'value')}) SELECT event_id, event_type, round(value, 6) AS value "
                         "FROM events, f WHERE value < f.lo OR value > f.hi")
    s["row_funnel"] = _funnel_sql()
    s["boxplot_fliers"] = """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events GROUP BY event_type),
f AS (SELECT event_type, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT e.event_id, e.event_type, round(e.value, 6) AS value
FROM events e JOIN f USING (event_type) WHERE e.value < f.lo OR e.value > f.hi"""
    # -- aggregations
    s["group_mean_count"] = (f"WITH {SAMPLES} SELECT point, round(round_even(avg(turbidity), 3), 6) AS mean, "
                             "count(turbidity) AS n_samples FROM samples WHERE point IS NOT NULL GROUP BY point")
    s["quantiles"] = (f"WITH {SAMPLES} SELECT point, "
                      + ", ".join(f"round(quantile_cont(turbidity, {p}), 6) AS p{int(p * 100)}"
                                  for p in (0.1, 0.25, 0.5, 0.75, 0.9))
                      + " FROM samples GROUP BY point")
    s["missing_profile"] = _missing_sql()
    s["missing_log"] = _missing_log_sql()
    s["target_summary"] = (f"WITH {SAMPLES} SELECT round(min(turbidity), 6) AS min, round(max(turbidity), 6) AS max, "
                           "round(avg(turbidity), 6) AS mean, round(quantile_cont(turbidity, 0.5), 6) AS median "
                           "FROM samples")
    s["boxplot_stats"] = """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT f.event_type, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper, count(e.value) AS n,
       round(min(CASE WHEN e.value BETWEEN lower AND upper THEN e.value END), 6) AS whisker_low,
       round(max(CASE WHEN e.value BETWEEN lower AND upper THEN e.value END), 6) AS whisker_high,
       count(*) FILTER (WHERE NOT (e.value BETWEEN lower AND upper)) AS n_fliers
FROM f JOIN events e USING (event_type) GROUP BY f.event_type"""
    s["cv_mean_std"] = f"""WITH {PRED},
m AS (SELECT model, CAST(sample_id % 5 AS INTEGER) AS fold, count(*) AS n,
             sum((predicted - actual) * (predicted - actual)) AS sse, var_pop(actual) AS v FROM pred GROUP BY ALL),
sc AS (SELECT model, fold, CASE WHEN n * v = 0 THEN CASE WHEN sse = 0 THEN 1e0 ELSE 0e0 END ELSE 1 - sse / (n * v) END AS r2 FROM m)
SELECT model, round(avg(r2), 6) AS cv_mean, round(stddev_pop(r2), 6) AS cv_std,
       round(stddev_samp(r2), 6) AS cv_std_sample FROM sc GROUP BY model"""
    s["residual_stats"] = (f"WITH {PRED} SELECT model, count(predicted - actual) AS n, "
                           "round(avg(predicted - actual), 6) AS mean_error, "
                           "round(stddev_pop(predicted - actual), 6) AS std_error FROM pred GROUP BY model")
    s["residual_hist"] = _hist_sql()
    s["residual_kde"] = _kde_sql()
    s["joint_range"] = (f"WITH {PRED} SELECT round(least(min(actual), min(predicted)), 6) AS range_min, "
                        "round(greatest(max(actual), max(predicted)), 6) AS range_max FROM pred")
    # -- reshaping
    s["run_ids"] = f"""WITH {MEAS},
l AS (SELECT ord, point, sample_date,
             CASE WHEN lag(point) OVER w IS DISTINCT FROM point OR lag(sample_date) OVER w IS DISTINCT FROM sample_date
                  THEN 1 ELSE 0 END AS st FROM meas WINDOW w AS (ORDER BY ord))
SELECT ord, point, sample_date, CAST(sum(st) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM l"""
    s["pivot_last_run"] = _pivot_last_run_sql()
    s["pivot_fill_rank"] = f"""WITH {IMP},
w AS (SELECT feature, coalesce(max(CASE WHEN model = 'A' THEN importance END), 0) AS "A",
             coalesce(max(CASE WHEN model = 'N' THEN importance END), 0) AS "N",
             coalesce(max(CASE WHEN model = 'R' THEN importance END), 0) AS "R" FROM imp GROUP BY feature)
SELECT feature, round("A", 6) AS "A", round("N", 6) AS "N", round("R", 6) AS "R",
       CAST(row_number() OVER (ORDER BY ("A" + "N" + "R") / 3e0 DESC, feature) AS BIGINT) AS rank FROM w"""
    s["unpivot_metrics"] = f"""WITH {METRICS}
SELECT model, metric, round(value, 6) AS value, CASE WHEN metric = 'r2' THEN 'score' ELSE 'error' END AS kind
FROM (SELECT model, rmse, mae, r2 FROM mm) UNPIVOT (value FOR metric IN (rmse, mae, r2))"""
    # -- sorts / top-k / windows
    s["topk"] = (f"WITH {IMP} SELECT model, feature, round(importance, 6) AS importance FROM imp "
                 "ORDER BY importance DESC, feature, model LIMIT 10")
    s["topk_per_group"] = f"""WITH {IMP},
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM imp)
SELECT model, feature, round(importance, 6) AS importance, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10"""
    cum = ("sum(importance) OVER (PARTITION BY model ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) "
           "/ NULLIF(sum(importance) OVER (PARTITION BY model), 0)")
    s["cumulative_share"] = (f"WITH {IMP} SELECT model, feature, round(importance, 6) AS importance, "
                             f"round({cum}, 6) AS cumulative FROM imp")
    s["cumulative_cut"] = f"""WITH {IMP},
c AS (SELECT *, {cum} AS cumulative,
             row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS position FROM imp),
k AS (SELECT *, sum(CASE WHEN coalesce(cumulative <= 0.95, false) THEN 1 ELSE 0 END) OVER (PARTITION BY model) AS nsel FROM c)
SELECT model, feature, round(importance, 6) AS importance, round(cumulative, 6) AS cumulative,
       CAST(position AS BIGINT) AS position FROM k
WHERE CASE WHEN nsel < 5 THEN position <= 5 ELSE coalesce(cumulative <= 0.95, false) END"""
    s["best_model"] = (f"WITH {METRICS} SELECT 'value' AS target, arg_min(model, (-r2, model)) AS best_model, "
                       "round(max(r2), 6) AS best_r2 FROM mm WHERE model IS NOT NULL AND r2 IS NOT NULL")
    s["sorted_pairs"] = (f"WITH {PRED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY model "
                         "ORDER BY actual, sample_id) AS BIGINT) AS position FROM pred) "
                         f"SELECT model, sample_id, {_r('actual', 'predicted')}, position, position - 1 AS index FROM r")
    # -- scalar functions
    s["spectral_indices"] = (f"WITH {TRAIN} SELECT sample_id, "
                             + _r("B2", "B3", "B4", "B5", "B8", "B11", "NDCI", "NDVI", "FAI", "MNDWI",
                                  "B3_B2_ratio", "B4_B3_ratio", "B5_B4_ratio", "Cloud_Percentage")
                             + ", Image_Date FROM train")
    s["engineered_features"] = (f"WITH {TRAIN}, e AS (SELECT sample_id, B4 / NULLIF(B5 + 1e-4, 0) AS B4_B5_ratio, "
                                "B3 / NULLIF(B5 + 1e-4, 0) AS B3_B5_ratio, NDCI * NDCI AS NDCI_squared, "
                                "MNDWI * MNDWI AS MNDWI_squared FROM train) SELECT sample_id, "
                                + _r("B4_B5_ratio", "B3_B5_ratio", "NDCI_squared", "MNDWI_squared") + " FROM e")
    s["raw_estimators"] = (f"WITH {TRAIN}, {PARAMS} SELECT sample_id, parameter, round({RAW_BY_NAME}, 6) AS raw_index "
                           "FROM train JOIN params USING (sample_id)")
    s["month_season"] = (f"WITH {SAMPLES} SELECT sample_id, CAST(month(sample_date) AS INTEGER) AS month, "
                         "CAST(floor((month(sample_date) % 12 + 3) / 3) AS INTEGER) AS season FROM samples")
    s["category_codes"] = """WITH c AS (SELECT o_orderkey AS sample_id,
                  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS category FROM orders),
d AS (SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT category FROM c WHERE category IS NOT NULL))
SELECT sample_id, coalesce(code, -1) AS category_code FROM c LEFT JOIN d USING (category)"""
    s["utm_inverse"] = _utm_sql()
    s["numeric_clean"] = f"WITH {DIRTY} SELECT sample_id, round({PARSE_NUM}, 6) AS value FROM dirty"
    s["date_multi_format"] = f"WITH {DIRTY} SELECT sample_id, {PARSE_DATE} AS sample_date FROM dirty"
    s["reject_split"] = f"""WITH {DIRTY},
p AS (SELECT sample_id, {PARSE_DATE} AS sample_date, {PARSE_NUM} AS value FROM dirty)
SELECT sample_id, sample_date, round(value, 6) AS value,
       CASE WHEN sample_date IS NULL THEN 'unparseable date' WHEN value IS NULL THEN 'unparseable number' END
         AS reject_reason FROM p"""
    s["epoch_date"] = """WITH e AS (SELECT o_orderkey AS sample_id,
                  (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 86400000 + o_orderkey % 86400000 AS time_start
           FROM orders),
d AS (SELECT sample_id, DATE '1970-01-01' + CAST(floor(time_start / 86400000) AS INTEGER) AS image_date FROM e)
SELECT sample_id, image_date, strftime(image_date, '%Y-%m-%d') AS image_date_text,
       CAST(image_date - 30 AS TIMESTAMP) AS window_start, CAST(image_date + 30 AS TIMESTAMP) AS window_end FROM d"""
    s["slug"] = "SELECT p_partkey AS part_id, lower(replace(replace(p_name, ' ', '_'), 'á', 'a')) AS slug FROM part"
    s["unit_map"] = f"""WITH {PARAMS}
SELECT sample_id, parameter, CASE parameter WHEN 'Clorofila a' THEN 'μg/L' WHEN 'Turbidez' THEN 'NTU'
       WHEN 'Transparência da Água' THEN 'm' WHEN 'Sólidos Dissolvidos Totais' THEN 'mg/L' END AS unit FROM params"""
    _oracle_batch2(s)
    _oracle_ingest(s)
    if LLM is not None:
        s |= {name: sql() for name, sql in LLM.ORACLES.items()}
    return s


def _oracle_ingest(s: dict) -> None:
    tagged = f"""{DIRTY},
ln AS (SELECT dirty.*, o_custkey % 200 - 100 AS lat, sample_id % 400 - 200 AS lon, sample_id AS k FROM dirty JOIN orders ON o_orderkey = sample_id),
ps AS (SELECT k, {PARSE_DATE} AS d, {PARSE_NUM} AS v, lat, lon, date_text, value_text FROM ln),
tg AS (SELECT *, k % 23 = 0 AS short, k % 29 = 0 AND k % 23 <> 0 AS long, k % 31 = 0 AND k % 29 <> 0 AND k % 23 <> 0 AS named FROM ps),
tr AS (SELECT CASE WHEN named THEN NULL ELSE k END AS sample_id, d AS sample_date, CASE WHEN short THEN NULL ELSE v END AS value,
  CASE WHEN short THEN NULL ELSE CAST(lat AS DOUBLE) END AS latitude, CASE WHEN short THEN NULL ELSE CAST(lon AS DOUBLE) END AS longitude,
  CASE WHEN short THEN k || ';' || date_text WHEN long THEN concat_ws(';', k, date_text, value_text, lat, lon, 'more') END AS malformed,
  CASE WHEN short OR long THEN 'malformed line' WHEN named THEN 'missing key' WHEN d IS NULL THEN 'unparseable date'
    WHEN v IS NULL THEN 'unparseable number' WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
    THEN 'outside the globe' END AS reject_reason FROM tg)"""
    cols = "sample_id, sample_date, round(value, 6) AS value, latitude, longitude"
    s["ingest_samples"] = f"WITH {tagged} SELECT {cols} FROM tr WHERE reject_reason IS NULL"
    s["ingest_rejects"] = f"WITH {tagged} SELECT reject_reason, malformed, {cols} FROM tr WHERE reject_reason IS NOT NULL"
    s["ingest_counts"] = f"""WITH {tagged}, names AS (SELECT unnest(['kept', 'malformed line', 'missing key', 'unparseable date',
  'unparseable number', 'outside the globe']) AS outcome)
SELECT outcome, count(tr.latitude IS NULL) AS n FROM names LEFT JOIN tr ON coalesce(reject_reason, 'kept') = outcome GROUP BY outcome"""
    s["residual_kde_by_model"] = f"""WITH {PRED},
r AS (SELECT model, predicted - actual AS v FROM pred),
st AS (SELECT model, count(v) AS n, min(v) AS mn, max(v) AS mx, stddev_samp(v) AS sd FROM r GROUP BY model),
p AS (SELECT model AS g, n, mn, sd * pow(n, -0.2) AS h, (mx - mn) / 99e0 AS step FROM st WHERE sd > 0),
a AS (SELECT p.*, (v - mn) / (h / 400) AS pos FROM r JOIN p ON model IS NOT DISTINCT FROM g),
b AS (SELECT g, n, mn, h, step, b, sum(w) AS w FROM (
  SELECT g, n, mn, h, step, floor(pos) AS b, 1 - (pos - floor(pos)) AS w FROM a
  UNION ALL SELECT g, n, mn, h, step, floor(pos) + 1, pos - floor(pos) FROM a) GROUP BY ALL),
s AS (SELECT g, i, sum(CASE WHEN abs(i * step - b * h / 400) <= 8.5 * h THEN w * exp(-0.5e0 * pow((i * step - b * h / 400) / h, 2)) ELSE 0 END) AS s
  FROM b, range(100) t(i) GROUP BY g, i)
SELECT p.g AS model, CAST(i AS INTEGER) AS i, round(mn + i * step, 6) AS x, round(s / (n * h * sqrt(2e0 * pi())), 6) AS density
FROM p JOIN s ON p.g IS NOT DISTINCT FROM s.g"""
    n = "1.0e0 / 298.257223563e0 / (2 - 1.0e0 / 298.257223563e0)"
    series = lambda f, g: " + ".join(f"a{j} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j in range(1, 5))
    s["pixel_from_lonlat"] = f"""WITH c AS (SELECT {n} AS n),
k AS (SELECT *, 6378137e0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) * 0.9996e0 AS ka, 2 * sqrt(n) / (1 + n) AS e,
  n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1,
  13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2,
  61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4 FROM c),
st AS (SELECT s_name AS point, radians(-18e0 - s_acctbal / 10000e0) AS phi,
  radians(-51e0 - CAST(s_nationkey AS DOUBLE) / 100e0 - (-51e0)) AS dl FROM supplier),
t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM st, k),
u AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t),
v AS (SELECT point, 5e5 + ka * (eta + {series('cos', 'sinh')}) AS x, 1e7 + ka * (xi + {series('sin', 'cosh')}) AS y FROM u)
SELECT point, round(x, 3) AS x_m, round(y, 3) AS y_m, CAST(floor(x / 10) AS BIGINT) AS px, CAST(floor(y / 10) AS BIGINT) AS py FROM v"""


SCENE_SAMPLES = """ss AS (
  SELECT o_orderkey AS sample_id, CAST(o_orderdate AS DATE) AS sample_date,
         -52e0 + CAST(o_custkey % 40 AS DOUBLE) * 5e-2 AS longitude,
         -19e0 + CAST(floor(o_custkey / 40) AS DOUBLE) * 5e-2 AS latitude FROM orders)"""
SCENES = """sc AS (
  SELECT o_orderkey AS scene_id,
         (-52e0 + CAST(o_orderkey % 40 AS DOUBLE) * 5e-2) - 12e-2 AS min_lon,
         (-19e0 + CAST(floor(o_orderkey / 400) AS DOUBLE) * 5e-2) - 12e-2 AS min_lat,
         (-52e0 + CAST(o_orderkey % 40 AS DOUBLE) * 5e-2) + 12e-2 AS max_lon,
         (-19e0 + CAST(floor(o_orderkey / 400) AS DOUBLE) * 5e-2) + 12e-2 AS max_lat,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS acquired_at,
         o_totalprice % 100 AS cloud_pct FROM orders)"""
BEST = SCENE_SAMPLES + ",\n" + SCENES + """,
cand AS (SELECT ss.sample_id, sc.scene_id, sc.cloud_pct, sc.acquired_at, sc.min_lon, sc.min_lat,
                abs(epoch(sc.acquired_at) - epoch(CAST(ss.sample_date AS TIMESTAMP))) AS dt
         FROM ss JOIN sc ON ss.longitude BETWEEN sc.min_lon AND sc.max_lon
                        AND ss.latitude BETWEEN sc.min_lat AND sc.max_lat
                        AND sc.acquired_at >= CAST(ss.sample_date - 30 AS TIMESTAMP)
                        AND sc.acquired_at < CAST(ss.sample_date + 30 AS TIMESTAMP)),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY cloud_pct, dt, scene_id) AS rn FROM cand),
best AS (SELECT ss.*, rk.scene_id, rk.cloud_pct, rk.acquired_at, rk.min_lon AS scene_min_lon,
                rk.min_lat AS scene_min_lat, CAST(rk.acquired_at AS DATE) AS image_date
         FROM ss LEFT JOIN rk ON ss.sample_id = rk.sample_id AND rk.rn = 1)"""

SCENE_PIXELS = """spix AS (
  SELECT l_orderkey AS scene_id, CAST(l_linenumber % 2 AS BIGINT) AS px,
         CAST(floor(l_linenumber / 2) % 2 AS BIGINT) AS py,
         300e0 + sum(l_quantity) * 20 AS B2, 250e0 + sum(round(l_extendedprice)) % 900 AS B3,
         200e0 + sum(round(l_discount * 100)) * 30 AS B4, 150e0 + sum(round(l_tax * 100)) * 25 AS B5,
         CAST(100e0 + count(*) * 400 AS DOUBLE) AS B8, 80e0 + max(l_quantity) * 12 AS B11
  FROM lineitem GROUP BY ALL)"""

BAND_NAMES = ["B2", "B3", "B4", "B5", "B8", "B11"]
OK_RULE = ("coalesce(B2 IS NOT NULL AND B3 IS NOT NULL AND B4 IS NOT NULL AND B5 IS NOT NULL AND B8 IS NOT NULL "
           "AND B11 IS NOT NULL AND (B5 + B4) <> 0 AND (B8 + B4) <> 0 AND (B3 + B11) <> 0 AND B2 <> 0 "
           "AND B3 <> 0 AND B4 <> 0, false)")


def _enrichment_sql() -> str:
    idx = {"NDCI": "(B5 - B4) / (B5 + B4)", "NDVI": "(B8 - B4) / (B8 + B4)",
           "FAI": f"B8 - (B4 + (B11 - B4) * {FAI_K})", "MNDWI": "(B3 - B11) / (B3 + B11)",
           "B3_B2_ratio": "B3 / B2", "B4_B3_ratio": "B4 / B3", "B5_B4_ratio": "B5 / B4"}
    cols = [f"round(CASE WHEN ok THEN {b} END, 6) AS {b}" for b in BAND_NAMES]
    cols += [f"round(CASE WHEN ok THEN {e} END, 6) AS {n}" for n, e in idx.items()]
    return f"""WITH {BEST}, {SCENE_PIXELS},
kp AS (SELECT best.*, CAST(floor((longitude - scene_min_lon) / 12e-2) AS BIGINT) AS px,
              CAST(floor((latitude - scene_min_lat) / 12e-2) AS BIGINT) AS py FROM best),
j AS (SELECT kp.*, spix.B2, spix.B3, spix.B4, spix.B5, spix.B8, spix.B11
      FROM kp LEFT JOIN spix ON kp.scene_id = spix.scene_id AND kp.px = spix.px AND kp.py = spix.py),
o AS (SELECT *, {OK_RULE} AS ok FROM j),
e AS (SELECT sample_id, sample_date, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude,
             {", ".join(cols)},
             CASE WHEN ok THEN image_date END AS Image_Date,
             round(CASE WHEN ok THEN cloud_pct END, 6) AS Cloud_Percentage FROM o)
SELECT *, CAST(month(Image_Date) AS INTEGER) AS Month,
       CAST(floor((month(Image_Date) % 12 + 3) / 3) AS INTEGER) AS Season FROM e"""


def _prep(prefix: str, target: str, thr: int = 10) -> str:
    """Preprocessing chain for one target: cloud filter, NULL target, IQR
    keep, exact 80/20 md5 split (features are complete after the cloud
    filter, so median imputation changes nothing)."""
    return f"""{prefix}0 AS (SELECT * FROM train WHERE Cloud_Percentage <= {thr} AND {target} IS NOT NULL),
{prefix}f AS ({_iqr(prefix + '0', target)}),
{prefix}1 AS (SELECT {prefix}0.*, {target} AS label FROM {prefix}0, {prefix}f
              WHERE {target} BETWEEN {prefix}f.lo AND {prefix}f.hi),
{prefix}2 AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) || '|42'), sample_id)
                        <= ceil(0.2 * count(*) OVER ()) AS is_test FROM {prefix}1)"""


RAW_TURB = "(B4 - B3) / NULLIF(B4 + B3, 0)"
RAW_CHL = "(1e0 / NULLIF(B3, 0) - 1e0 / NULLIF(B4, 0)) * B8"


def _oracle_batch2(s: dict) -> None:
    # -- sources / sinks
    s["csv_round_trip"] = f"WITH {SAMPLES} SELECT {SAMPLE_COLS} FROM samples"
    s["latest_snapshot"] = """WITH m AS (SELECT user_id, max(ts) AS mt FROM events GROUP BY user_id)
SELECT e.event_id, e.user_id, e.ts, e.event_type, round(e.value, 6) AS value
FROM events e JOIN m ON e.user_id = m.user_id AND e.ts = m.mt"""
    s["resume_anti"] = ("SELECT doc_id, lang, n_chars FROM documents d "
                        "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
    # -- joins
    s["lookup_left"] = ("SELECT doc_id, lang, source, n_chars, quality, toxic "
                        "FROM documents LEFT JOIN labels USING (doc_id)")
    s["override_upsert"] = """WITH st AS (SELECT s_name AS point, -18e0 - s_acctbal / 10000e0 AS latitude,
                   -51e0 - CAST(s_nationkey AS DOUBLE) / 100e0 AS longitude FROM supplier),
fx AS (SELECT s_name AS point, -18.5e0 + CAST(s_suppkey AS DOUBLE) / 1000e0 AS latitude,
              -51.5e0 + CAST(s_suppkey AS DOUBLE) / 1000e0 AS longitude FROM supplier WHERE s_suppkey % 3 = 0)
SELECT st.point, round(coalesce(fx.latitude, st.latitude), 6) AS latitude,
       round(coalesce(fx.longitude, st.longitude), 6) AS longitude FROM st LEFT JOIN fx USING (point)"""
    s["harmonise_union"] = """
SELECT 'cemig_turbidity' AS source, 'C' || CAST(c_custkey AS VARCHAR) AS point, CAST(NULL AS DATE) AS "date",
       round(CAST(c_nationkey AS DOUBLE), 6) AS latitude, round(CAST(-c_nationkey AS DOUBLE), 6) AS longitude,
       round(c_acctbal, 6) AS turbidity, CAST(NULL AS DOUBLE) AS chlorophyll FROM customer
UNION ALL SELECT 'cemig_both', 'S' || CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL,
       round(CAST(s_nationkey AS DOUBLE), 6), round(s_acctbal, 6) FROM supplier
UNION ALL SELECT 'codevasf', 'R' || CAST(p_partkey AS VARCHAR), NULL, -18.2e0, -45.1e0, NULL,
       round(p_retailprice, 6) FROM part
UNION ALL SELECT 'guaicuy', 'O' || CAST(o_orderkey AS VARCHAR), CAST(o_orderdate AS DATE), NULL, NULL,
       round(o_totalprice / 1000e0, 6), NULL FROM orders
UNION ALL SELECT 'long', 'E' || CAST(user_id AS VARCHAR), CAST(ts AS DATE), NULL, NULL,
       CASE WHEN event_id % 3 = 0 THEN round(value, 6) END, CASE WHEN event_id % 3 = 1 THEN round(value, 6) END FROM events"""
    # -- scenes
    s["best_scene"] = (f"WITH {BEST} SELECT sample_id, scene_id, round(cloud_pct, 6) AS cloud_pct, image_date "
                       "FROM best")
    s["coverage"] = (f"WITH {BEST} SELECT count(*) AS total, count(scene_id) AS with_image, "
                     "round(CAST(count(scene_id) AS DOUBLE) * 100e0 / count(*), 6) AS pct_with_image FROM best")
    s["cell_contains"] = (f"WITH {SCENE_SAMPLES}, {SCENES} SELECT ss.sample_id, count(*) AS n_scenes FROM ss JOIN sc "
                          "ON ss.longitude BETWEEN sc.min_lon AND sc.max_lon "
                          "AND ss.latitude BETWEEN sc.min_lat AND sc.max_lat GROUP BY ss.sample_id")
    a, b = 0.117, 0.061
    ring = [(-a, -b), (b, -a), (a, b), (-b, a)]
    left = " AND ".join(f"({x2 - x1!r}) * (latitude - (cy + {y1!r})) - ({y2 - y1!r}) * (longitude - (cx + {x1!r})) >= 0"
                        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))  # left of all edges
    s["outline_contains"] = f"""WITH {SCENE_SAMPLES},
sq AS (SELECT -52e0 + CAST(o_orderkey % 40 AS DOUBLE) * 5e-2 AS cx, -19e0 + CAST(floor(o_orderkey / 400) AS DOUBLE) * 5e-2 AS cy FROM orders)
SELECT sample_id, count(*) AS n_scenes FROM ss JOIN sq ON longitude BETWEEN cx - 0.12 AND cx + 0.12
  AND latitude BETWEEN cy - 0.12 AND cy + 0.12 AND {left} GROUP BY sample_id"""
    s["pixel_sample"] = """WITH pts AS (SELECT o_orderkey AS sample_id, o_custkey % 50 AS scene_id,
                    CAST(o_orderkey % 1000 AS DOUBLE) + 5e-1 AS x_m, o_totalprice % 70 AS y_m FROM orders),
k AS (SELECT sample_id, scene_id, CAST(floor(x_m / 10e0) AS BIGINT) AS px,
             CAST(floor(y_m / 10e0) AS BIGINT) AS py FROM pts),
pix AS (SELECT l_suppkey % 50 AS scene_id, l_partkey % 100 AS px, CAST(l_linenumber AS BIGINT) AS py,
               sum(l_quantity) AS B2, CAST(count(*) AS DOUBLE) AS B3, max(l_quantity) AS B4,
               min(l_quantity) AS B5, sum(round(l_tax * 100)) AS B8, sum(round(l_discount * 100)) AS B11
        FROM lineitem GROUP BY ALL)
SELECT k.sample_id, k.scene_id, k.px, k.py, round(B2, 6) AS B2, round(B3, 6) AS B3, round(B4, 6) AS B4,
       round(B5, 6) AS B5, round(B8, 6) AS B8, round(B11, 6) AS B11
FROM k LEFT JOIN pix ON k.scene_id = pix.scene_id AND k.px = pix.px AND k.py = pix.py"""
    s["scene_enrichment"] = _enrichment_sql()
    # -- learning, exact parts
    med = ", ".join(f"quantile_cont({b}, 0.5) AS m_{b}" for b in BAND_NAMES)
    s["impute_median"] = (f"WITH {BANDS}, m AS (SELECT {med} FROM bands) SELECT sample_id, "
                          + ", ".join(f"round(coalesce({b}, m_{b}), 6) AS {b}" for b in BAND_NAMES)
                          + " FROM bands, m")
    stats = ", ".join(f"avg({b}) AS m_{b}, stddev_pop({b}) AS s_{b}" for b in BAND_NAMES)
    s["standardise"] = (f"""WITH {BANDS},
sp AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) || '|42'), sample_id)
                 <= ceil(0.2 * count(*) OVER ()) AS is_test FROM bands),
st AS (SELECT {stats} FROM sp WHERE NOT is_test)
SELECT sample_id, is_test, """ + ", ".join(
        f"round(({b} - m_{b}) / CASE WHEN s_{b} IS NULL OR s_{b} = 0 OR isnan(s_{b}) THEN 1e0 ELSE s_{b} END, 6) AS {b}"
        for b in BAND_NAMES) + " FROM sp, st")
    s["hash_split"] = (f"WITH {SAMPLES} SELECT sample_id, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) "
                       "|| '|42'), sample_id) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM samples")
    s["regression_metrics"] = (f"WITH {METRICS} SELECT model, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, "
                               "round(r2, 6) AS r2 FROM mm")
    both = TRAIN + ",\n" + _prep("tp", "turbidity") + ",\n" + _prep("cp", "chlorophyll")
    s["ols_calibration"] = f"""WITH {both},
tt AS (SELECT label, {RAW_TURB} AS x FROM tp2 WHERE NOT is_test),
ct AS (SELECT label, {RAW_CHL} AS x FROM cp2 WHERE NOT is_test)
SELECT 'Turbidez' AS parameter, count(*) FILTER (WHERE x IS NOT NULL AND label IS NOT NULL) AS n,
       round(regr_slope(label, x), 6) AS slope, round(regr_intercept(label, x), 6) AS intercept,
       round(regr_r2(label, x), 6) AS r2 FROM tt
UNION ALL
SELECT 'Clorofila a', count(*) FILTER (WHERE x IS NOT NULL AND label IS NOT NULL), round(regr_slope(label, x), 6),
       round(regr_intercept(label, x), 6), round(regr_r2(label, x), 6) FROM ct"""
    turb = TRAIN + ",\n" + _prep("tp", "turbidity")
    s["calibrated_index"] = f"""WITH {turb},
c AS (SELECT regr_slope(label, {RAW_TURB}) AS a, regr_intercept(label, {RAW_TURB}) AS b FROM tp2 WHERE NOT is_test)
SELECT sample_id, round({RAW_TURB}, 6) AS raw_index,
       round(coalesce(a * {RAW_TURB} + b, {RAW_TURB}), 6) AS calibrated FROM tp2, c WHERE is_test"""

    def _val(prefix, raw, param, unit):
        return f"""SELECT '{param}' AS parameter, '{unit}' AS unit, 'Index_Based' AS method,
       round(CASE WHEN count(*) * var_pop(label) = 0 THEN CASE WHEN sum((p - label) * (p - label)) = 0 THEN 1e0 ELSE 0e0 END
             ELSE 1 - sum((p - label) * (p - label)) / (count(*) * var_pop(label)) END, 6) AS r2,
       round(sqrt(avg((p - label) * (p - label))), 6) AS rmse
FROM (SELECT label, coalesce(a * {raw} + b, {raw}) AS p FROM {prefix}2,
        (SELECT regr_slope(label, {raw}) AS a, regr_intercept(label, {raw}) AS b FROM {prefix}2 WHERE NOT is_test)
      WHERE is_test) q WHERE p IS NOT NULL AND label IS NOT NULL"""
    s["index_validation"] = (f"WITH {both} " + _val("tp", RAW_TURB, "Turbidez", "NTU") + " UNION ALL "
                             + _val("cp", RAW_CHL, "Clorofila a", "μg/L"))
    s["kfold_ols"] = f"""WITH {turb},
tr AS (SELECT sample_id, label AS y, {RAW_TURB} AS x FROM tp2 WHERE NOT is_test),
fo AS (SELECT *, CAST(ntile(5) OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) || '|42'), sample_id) - 1 AS INTEGER)
                 AS fold FROM tr),
tot AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM fo),
pf AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM fo GROUP BY fold),
tr2 AS (SELECT fold, tot.n - pf.n AS m, tot.sx - pf.sx AS sx, tot.sy - pf.sy AS sy, tot.sxx - pf.sxx AS sxx,
               tot.sxy - pf.sxy AS sxy FROM pf, tot),
co AS (SELECT fold, (m * sxy - sx * sy) / (m * sxx - sx * sx) AS w, sy / m - (m * sxy - sx * sy) / (m * sxx - sx * sx) * sx / m AS b FROM tr2),
sc AS (SELECT fo.fold, count(*) AS n, sum((b + w * x - y) * (b + w * x - y)) AS sse, var_pop(y) AS v
       FROM fo JOIN co USING (fold) GROUP BY fo.fold)
SELECT fold, n, round(CASE WHEN n * v = 0 THEN CASE WHEN sse = 0 THEN 1e0 ELSE 0e0 END ELSE 1 - sse / (n * v) END, 6) AS r2
FROM sc"""
    s["ridge_closed"] = f"""WITH {turb},
tr AS (SELECT label AS y, {RAW_TURB} AS x FROM tp2 WHERE NOT is_test),
c AS (SELECT sum(x * y) - sum(x) * sum(y) / count(*) AS cxy, sum(x * x) - sum(x) * sum(x) / count(*) AS cxx,
             avg(x) AS mx, avg(y) AS my FROM tr)
SELECT 1e0 AS alpha, round(cxy / (cxx + 1e0), 6) AS slope, round(my - cxy / (cxx + 1e0) * mx, 6) AS intercept FROM c"""
    s["index_validation_raw"] = f"""WITH {turb}
SELECT 'Turbidez' AS parameter, 'NTU' AS unit, 'Index_Based' AS method,
       round(1 - sum((p - label) * (p - label)) / (count(*) * var_pop(label)), 6) AS r2,
       round(sqrt(avg((p - label) * (p - label))), 6) AS rmse
FROM (SELECT label, {RAW_TURB} AS p FROM tp2 WHERE is_test) q WHERE p IS NOT NULL AND label IS NOT NULL"""
    s["row_index"] = (f"WITH {SAMPLES} SELECT sample_id, sample_date, row_number() OVER (ORDER BY sample_date, sample_id) - 1 "
                      "AS row_index FROM samples")
    s["validation_linear"] = f"""WITH {turb},
ml AS (SELECT regr_slope(label, NDCI) AS w, regr_intercept(label, NDCI) AS b FROM tp2 WHERE NOT is_test),
ix AS (SELECT regr_slope(label, {RAW_TURB}) AS a, regr_intercept(label, {RAW_TURB}) AS c FROM tp2 WHERE NOT is_test)
SELECT sample_id, round(label, 6) AS "Actual", {", ".join(f"round({b}, 6) AS {b}_value" for b in BAND_NAMES)},
  round(coalesce(a * {RAW_TURB} + c, {RAW_TURB}), 6) AS "Index_Based", round(w * NDCI + b, 6) AS "ML_Predicted" FROM tp2, ml, ix WHERE is_test"""
    run = TRAIN + ",\n" + _prep("tq", "turbidity", 20) + """,
rt AS (SELECT sample_id, label AS y, NDCI AS x, ntile(5) OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) || '|42'), sample_id) - 1 AS fold
  FROM tq2 WHERE NOT is_test),
co AS (SELECT f.fold, regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM (SELECT DISTINCT fold FROM rt) f JOIN rt ON rt.fold <> f.fold GROUP BY f.fold),
cv AS (SELECT rt.fold, 1 - sum((w * x + b - y) * (w * x + b - y)) / (count(*) * var_pop(y)) AS r2 FROM rt JOIN co USING (fold) GROUP BY rt.fold),
al AS (SELECT regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM rt),
te AS (SELECT sample_id, label AS y, w * NDCI + b AS p FROM tq2, al WHERE is_test)"""
    s["cv_score_table"] = f"WITH {run} SELECT 'Linear' AS model, CAST(fold AS INTEGER) AS fold, round(r2, 6) AS r2 FROM cv"
    s["prediction_table"] = (f"WITH {run} SELECT 'Linear' AS model, sample_id, round(y, 6) AS label, round(p, 6) AS prediction FROM te")
    s["comparison_linear"] = f"""WITH {run}
SELECT 'turbidity' AS target, 'Linear' AS model, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
  round(1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)), 6) AS r2, round((SELECT avg(r2) FROM cv), 6) AS cv_mean,
  round((SELECT stddev_pop(r2) FROM cv), 6) AS cv_std FROM te"""
    lin = Q.LINEAR_FEATURES
    moved = " UNION ALL ".join(
        f"SELECT {j} AS feature, r AS repeat, a.y, 200e0 + " + " + ".join(
            f"{w!r} * {'o' if i == j else 'a'}.{f}" for i, (f, w) in enumerate(lin.items()))
        + f" AS p FROM b a, range(4) t(r), b o WHERE o.block = a.block AND o.pos = (a.pos + CASE WHEN a.size > 1 "
          f"THEN 1 + ((r * {len(lin)} + {j}) * 7919) % (a.size - 1) ELSE 0 END) % a.size" for j in range(len(lin)))
    score = "1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y))"
    plain = "200e0 + " + " + ".join(f"{w!r} * {f}" for f, w in lin.items())
    s["permutation_linear"] = f"""WITH {turb},
tr AS (SELECT label AS y, {", ".join(lin)}, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(sample_id AS VARCHAR)
  || '|42'), 1, 13) AS BIGINT), sample_id) - 1 AS n FROM tp2 WHERE NOT is_test AND {" AND ".join(f"{f} IS NOT NULL" for f in lin)}),
b AS (SELECT *, n // 4096 AS block, n % 4096 AS pos, count(*) OVER (PARTITION BY n // 4096) AS size FROM tr),
base AS (SELECT {score} AS r0 FROM (SELECT y, {plain} AS p FROM b)),
sc AS (SELECT feature, repeat, {score} AS r2 FROM ({moved}) GROUP BY ALL)
SELECT ['{"', '".join(lin)}'][feature + 1] AS feature, round(avg(r0 - r2), 6) AS importance_mean,
  round(stddev_pop(r0 - r2), 6) AS importance_std FROM sc, base GROUP BY feature"""
    s["tree_exact"] = f"WITH {turb}, {_tree_sql(['NDCI', 'MNDWI', 'B8'], 20, 5)}"
    # the best intercept for a slope is the median of all residuals -/+ epsilon; the slope by golden section
    s["svr_linear"] = f"""WITH RECURSIVE {turb},
tr AS (SELECT label AS y, {RAW_TURB} AS x FROM tp2 WHERE NOT is_test AND {RAW_TURB} IS NOT NULL),
box AS (SELECT max(abs(y)) * 4 / greatest(max(abs(x)), 1e-9) + sqrt(2 * sum(abs(y))) AS top FROM tr),
st AS (SELECT 0 AS i, -top AS lo, top AS hi FROM box
  UNION ALL
  SELECT i + 1, CASE WHEN f1 > f2 THEN w1 ELSE lo END, CASE WHEN f1 > f2 THEN hi ELSE w2 END FROM (
    SELECT i, lo, hi, min(w) AS w1, max(w) AS w2, arg_min(f, w) AS f1, arg_max(f, w) AS f2 FROM (
      SELECT i, lo, hi, w, w * w / 2 + sum(greatest(abs(r - b) - 0.1e0, 0)) AS f FROM (
        SELECT i, lo, hi, w, r, median(r + e) OVER (PARTITION BY w) AS b, e FROM (
          SELECT i, lo, hi, w, y - w * x AS r FROM (SELECT i, lo, hi, unnest([hi - (hi - lo) / 1.618033988749895e0,
            lo + (hi - lo) / 1.618033988749895e0]) AS w FROM st WHERE i < 90), tr), (VALUES (-0.1e0), (0.1e0)) v(e))
      WHERE e > 0 GROUP BY i, lo, hi, w) GROUP BY i, lo, hi)),
fin AS (SELECT (lo + hi) / 2 AS w FROM st ORDER BY i DESC LIMIT 1),
rb AS (SELECT w, y - w * x AS r FROM fin, tr),
b AS (SELECT median(r + e) AS b FROM rb, (VALUES (-0.1e0), (0.1e0)) v(e))
SELECT count(*) AS n, round((any_value(w) * any_value(w) / 2 + sum(greatest(abs(r - b) - 0.1e0, 0))) / count(*), 4)
  AS objective_per_row FROM rb, b"""
    for kind in ("ridge", "lasso"):
        s[f"{kind}_cv_single"] = f"WITH {turb}, {_cv_sql(kind, nested=False)}\n" + """
SELECT round(alpha, 6) AS alpha, round(w, 6) AS slope, round(b, 6) AS intercept FROM final"""
        s[f"{kind}_cv_scores"] = f"WITH {turb}, {_cv_sql(kind, nested=True)}\n" + """
SELECT CAST(o AS INTEGER) AS fold, round(1 - (syy - 2 * w * sxy - 2 * b * sy + w * w * sxx + 2 * w * b * sx + n * b * b)
                                         / (syy - sy * sy / n), 6) AS r2
FROM final JOIN (SELECT fold AS o2, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy,
                        sum(y * y) AS syy FROM fo GROUP BY fold) ON o = o2"""


def _tree_sql(features, min_split: int, min_leaf: int, depth: int = 2) -> str:
    """Exact regression tree, a block of CTEs per level, by self-comparison of all values."""
    parts = ["l0 AS (SELECT '' AS node, label AS y, " + ", ".join(features) + " FROM tp2 WHERE NOT is_test)"]
    out = []
    for d in range(depth + 1):
        parts.append(f"n{d} AS (SELECT node, count(*) AS nt, sum(y) AS st, var_pop(y) AS var FROM l{d} GROUP BY node)")
        if d == depth:
            out.append(f"SELECT node, {d} AS depth, nt AS n, st / nt AS value, NULL AS feature, NULL AS threshold, NULL AS gain FROM n{d}")
            break
        long = " UNION ALL ".join(f"SELECT node, y, '{f}' AS feature, {f} AS v FROM l{d} WHERE {f} IS NOT NULL" for f in features)
        parts.append(f"""v{d} AS (SELECT node, feature, v, lead(v) OVER w AS v2, sum(c) OVER w AS nl, sum(s) OVER w AS sl FROM (
  SELECT node, feature, v, count(*) AS c, sum(y) AS s FROM ({long}) GROUP BY ALL) WINDOW w AS (PARTITION BY node, feature ORDER BY v))""")
        parts.append(f"""g{d} AS (SELECT node, feature, (v + coalesce(v2, v)) / 2 AS threshold, gain FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, v) AS r FROM (
    SELECT node, feature, v, v2, round(sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt, 6) AS gain
    FROM v{d} JOIN n{d} USING (node) WHERE nt >= {min_split} AND var > 0 AND nl >= {min_leaf} AND nt - nl >= {min_leaf}) WHERE gain > 0) WHERE r = 1)""")
        pick = "CASE feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in features) + " END"
        parts.append(f"l{d + 1} AS (SELECT node || CASE WHEN coalesce({pick} <= threshold, false) THEN 'L' ELSE 'R' END AS node, "
                     f"y, {', '.join(features)} FROM l{d} JOIN g{d} USING (node))")
        out.append(f"SELECT node, {d}, nt, st / nt, feature, threshold, gain FROM n{d} LEFT JOIN g{d} USING (node)")
    u = " UNION ALL ".join([out[-1], *out[:-1]])
    return ", ".join(parts) + (f" SELECT node, CAST(depth AS INTEGER) AS depth, n, round(value, 6) AS value, feature, "
                               f"round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM ({u})")


def _cv_sql(kind: str, nested: bool) -> str:
    """5-fold alpha search on one feature in closed form, per outer fold ``o``
    (one, of all rows, unless ``nested``): ``final`` (o, alpha, w, b)."""
    src = ("SELECT o, h, sample_id, x, y FROM fo, range(5) r(o) WHERE fold <> o" if nested
           else "SELECT 0 AS o, h, sample_id, x, y FROM fo")
    sums = ("count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy")
    cxy, cxx = "(sxy - sx * sy / n)", "(sxx - sx * sx / n)"
    if kind == "ridge":
        grid = "SELECT o, unnest([0.1e0, 1e0, 10e0]) AS alpha FROM tot"
        w, score, first = f"{cxy} / ({cxx} + alpha)", "1 - sse / (vyy - vy * vy / vn)", "alpha"
    else:
        top = f"log10(abs({cxy}) / n)"
        grid = f"SELECT o, pow(10e0, {top} - 3 + i * 3e0 / 99) AS alpha FROM tot, range(100) r(i)"
        w = f"sign({cxy}) * greatest(abs({cxy} / n) - alpha, 0) / ({cxx} / n)"
        score, first = "-sse / vn", "alpha DESC"
    return f"""fo AS (SELECT sample_id, h, x, y, ntile(5) OVER (ORDER BY h, sample_id) - 1 AS fold FROM
  (SELECT sample_id, md5(CAST(sample_id AS VARCHAR) || '|42') AS h, label AS y, {RAW_TURB} AS x FROM tp2 WHERE NOT is_test)),
src AS ({src}),
inn AS (SELECT *, ntile(5) OVER (PARTITION BY o ORDER BY h, sample_id) AS g FROM src),
pf AS (SELECT o, g, {sums} FROM inn GROUP BY o, g),
tot AS (SELECT o, {sums} FROM inn GROUP BY o),
grid AS ({grid}),
part AS (SELECT p.o, p.g, alpha, t.n - p.n AS n, t.sx - p.sx AS sx, t.sy - p.sy AS sy, t.sxx - p.sxx AS sxx, t.sxy - p.sxy AS sxy,
  p.n AS vn, p.sx AS vx, p.sy AS vy, p.sxx AS vxx, p.sxy AS vxy, p.syy AS vyy
  FROM pf p JOIN tot t ON p.o = t.o JOIN grid ON grid.o = p.o),
fit AS (SELECT *, {w} AS w FROM part),
err AS (SELECT *, vyy - 2 * w * vxy - 2 * (sy / n - w * sx / n) * vy + w * w * vxx + 2 * w * (sy / n - w * sx / n) * vx
  + vn * (sy / n - w * sx / n) * (sy / n - w * sx / n) AS sse FROM fit),
score AS (SELECT o, alpha, avg({score}) AS s FROM err GROUP BY o, alpha),
best AS (SELECT o, alpha FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY s DESC, {first}) AS r FROM score) WHERE r = 1),
fin AS (SELECT tot.*, alpha, {w} AS w FROM tot JOIN best USING (o)),
final AS (SELECT o, alpha, w, sy / n - w * sx / n AS b FROM fin)"""
