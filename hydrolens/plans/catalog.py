"""Registered queries: each runs one operator of the inventory over whole
benchmark tables (via the stand-ins) and returns a DataFrame.

Floating results are rounded to 6 decimals at the end so that a different
summation order cannot change a value-level comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import spectral as S
from ..functions import text as T
from ..functions.geo import with_utm_inverse
from ..operators import clean as C
from ..operators import profile as P
from ..operators import ranking as R
from ..operators import reshape as RS
from . import standins as SI


def rounded(df: DataFrame, scale: int = 6) -> DataFrame:
    """Round every floating column (final presentation step)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), scale).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ---------------------------------------------------------------- projections / filters
def q_project_cols(spark, sf):
    return C.project(SI.samples(spark, sf), ["sample_id", "point", "sample_date", "turbidity"])


def q_threshold_filter(spark, sf):
    return rounded(C.threshold_filter(SI.samples(spark, sf), "cloud_pct", 10))


def q_drop_null_any(spark, sf):
    return rounded(C.drop_null_any(SI.samples(spark, sf), ["turbidity"]))


def q_drop_null_all(spark, sf):
    return rounded(C.drop_null_all(SI.samples(spark, sf), ["turbidity", "chlorophyll", "cloud_pct"]))


def q_geo_range(spark, sf):
    return rounded(C.geo_range(SI.samples(spark, sf)).select("sample_id", "latitude", "longitude"))


def _events_values(spark, sf):
    return SI.table(spark, sf, "events").select("event_id", "event_type", "value")


def q_iqr_keep(spark, sf):
    return rounded(P.iqr_keep(_events_values(spark, sf), "value"))


def q_iqr_outliers(spark, sf):
    return rounded(P.iqr_outliers(_events_values(spark, sf), "value"))


def q_boxplot_fliers(spark, sf):
    """Fliers of the per-group boxplots as rows (outside the group's own fences)."""
    return rounded(P.iqr_outliers(_events_values(spark, sf), "value", ["event_type"]))


def q_row_funnel(spark, sf):
    s = SI.samples(spark, sf)
    pre = C.drop_null_any(C.threshold_filter(s, "cloud_pct", 20), ["turbidity"])
    f = P.iqr_fences(pre, "turbidity").first()
    steps = [("cloud_pct <= 20", F.col("cloud_pct") <= 20),
             ("turbidity not null", F.col("turbidity").isNotNull()),
             ("turbidity inside IQR fences", F.col("turbidity").between(F.lit(f["lower"]), F.lit(f["upper"])))]
    return rounded(C.row_funnel(s, steps))


# ---------------------------------------------------------------- aggregations
def q_group_mean_count(spark, sf):
    return rounded(P.group_mean_count(SI.samples(spark, sf), "point", "turbidity"))


def q_quantiles(spark, sf):
    from ..operators.quantiles import exact_quantiles
    return rounded(exact_quantiles(SI.samples(spark, sf), "turbidity", [0.1, 0.25, 0.5, 0.75, 0.9],
                                   ["point"], names=["p10", "p25", "p50", "p75", "p90"]))


def q_missing_profile(spark, sf):
    return rounded(P.missing_profile(SI.samples(spark, sf)))


def q_missing_log(spark, sf):
    """Per-feature missing log of the training features: only features with
    gaps, share in % with one decimal."""
    t = SI.training_rows(spark, sf).select(*S.FEATURE_COLUMNS)
    return rounded(P.missing_profile(t, scale=1, only_missing=True))


def q_target_summary(spark, sf):
    return rounded(P.target_summary(SI.samples(spark, sf), "turbidity"))


def q_boxplot_stats(spark, sf):
    return rounded(P.boxplot_stats(_events_values(spark, sf), "value", ["event_type"]))


def _fold_scores(spark, sf):
    from ..operators.learn import regression_metrics
    p = SI.predictions(spark, sf).withColumn("fold", (F.col("sample_id") % 5).cast("int"))
    return regression_metrics(p, "actual", "predicted", ["model", "fold"])


def q_cv_mean_std(spark, sf):
    return rounded(P.cv_mean_std(_fold_scores(spark, sf), "r2", ["model"]))


def q_residual_stats(spark, sf):
    return rounded(P.residual_stats(SI.predictions(spark, sf), "actual", "predicted", ["model"]))


def _residuals(spark, sf):
    p = SI.predictions(spark, sf)
    return p.select((F.col("predicted") - F.col("actual")).alias("residual"))


def q_residual_hist(spark, sf):
    return rounded(P.histogram(_residuals(spark, sf), "residual", bins=30))


def q_residual_kde(spark, sf):
    k = P.gaussian_kde(_residuals(spark, sf), "residual", grid=200)
    return k.select("i", F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_e6"))


def q_residual_kde_by_model(spark, sf):
    p = SI.predictions(spark, sf).select("model", (F.col("predicted") - F.col("actual")).alias("residual"))
    return rounded(P.binned_kde(p, "residual", ["model"], grid=100))


def q_joint_range(spark, sf):
    return rounded(P.joint_range(SI.predictions(spark, sf), "actual", "predicted"))


def q_coverage(spark, sf):
    from ..operators.scenes import best_scene
    from .enrich import STANDIN_CELL_DEG
    b = best_scene(SI.scene_samples(spark, sf), SI.scenes(spark, sf), cell_deg=STANDIN_CELL_DEG)
    return rounded(P.coverage(b, "scene_id"))


# ---------------------------------------------------------------- reshaping
def q_run_ids(spark, sf):
    m = SI.measurements(spark, sf)
    return RS.run_ids(m, ["point", "sample_date"], "ord").select("ord", "point", "sample_date", "run_id")


def q_pivot_last_run(spark, sf):
    m = SI.measurements(spark, sf)
    return rounded(RS.pivot_last_run(m, ["point", "sample_date"], "ord", "parameter", "result", "unit"))


def q_pivot_fill_rank(spark, sf):
    return rounded(RS.pivot_fill_rank(SI.importances(spark, sf), "feature", "model", "importance")
                   .withColumn("rank", F.col("rank").cast("long")))


def _model_metrics(spark, sf):
    from ..operators.learn import regression_metrics
    return regression_metrics(SI.predictions(spark, sf), "actual", "predicted", ["model"])


def q_unpivot_metrics(spark, sf):
    m = _model_metrics(spark, sf)
    long = RS.unpivot_metrics(m, ["model"], ["rmse", "mae", "r2"])
    return rounded(long.withColumn("kind", F.when(F.col("metric") == "r2", "score").otherwise("error")))


# ---------------------------------------------------------------- sorts / top-k / windows
def q_topk(spark, sf):
    t = R.top_k(SI.importances(spark, sf), 10, [F.col("importance").desc(), F.col("feature"), F.col("model")])
    return rounded(t)


def q_topk_per_group(spark, sf):
    t = R.top_k_per_group(SI.importances(spark, sf), 10, ["model"],
                          [F.col("importance").desc(), F.col("feature")])
    return rounded(t.withColumn("rank", F.col("rank").cast("long")))


def q_cumulative_share(spark, sf):
    c = R.cumulative_share(SI.importances(spark, sf), "importance",
                           [F.col("importance").desc(), F.col("feature")], ["model"])
    return rounded(c)


def q_cumulative_cut(spark, sf):
    c = R.cumulative_cut(SI.importances(spark, sf), "importance",
                         [F.col("importance").desc(), F.col("feature")], ["model"])
    return rounded(c)


def q_best_model(spark, sf):
    m = _model_metrics(spark, sf).withColumn("target", F.lit("value"))
    return rounded(R.best_by(m, ["target"], "model", "r2", out="best_model"))


def q_sorted_pairs(spark, sf):
    s = R.sorted_pairs(SI.predictions(spark, sf), "actual", "sample_id", ["model"])
    return rounded(s.withColumn("index", F.col("position") - 1))  # 0-based plot x axis


# ---------------------------------------------------------------- scalar functions
def q_spectral_indices(spark, sf):
    t = SI.training_rows(spark, sf)
    return rounded(t.select("sample_id", *S.ENRICH_COLUMNS))


def q_engineered_features(spark, sf):
    t = S.engineered_features(SI.training_rows(spark, sf).select("sample_id", *S.BANDS, *S.INDEX_COLUMNS))
    return rounded(t.select("sample_id", "B4_B5_ratio", "B3_B5_ratio", "NDCI_squared", "MNDWI_squared"))


def q_raw_estimators(spark, sf):
    t = SI.training_rows(spark, sf).select("sample_id", *S.BANDS)
    p = SI.parameter_rows(spark, sf)
    j = t.join(p, "sample_id", "inner")
    return rounded(j.select("sample_id", "parameter", S.raw_estimator_by_name("parameter").alias("raw_index")))


def q_month_season(spark, sf):
    s = SI.samples(spark, sf)
    return s.select("sample_id", D.month_of("sample_date").alias("month"),
                    D.season_of_month(D.month_of("sample_date")).alias("season"))


def q_category_codes(spark, sf):
    from ..operators.learn import category_codes
    return category_codes(SI.categories(spark, sf), "category", "category_code") \
        .select("sample_id", "category_code")


def q_utm_inverse(spark, sf):
    return with_utm_inverse(SI.utm_points(spark, sf), "X", "Y", zone=22, south=True) \
        .select("station_id", F.round("Latitude", 8).alias("latitude"), F.round("Longitude", 8).alias("longitude"))


def q_numeric_clean(spark, sf):
    d = SI.dirty_text(spark, sf)
    return rounded(d.select("sample_id", N.to_double_lenient("value_text").alias("value")))


def q_date_multi_format(spark, sf):
    d = SI.dirty_text(spark, sf)
    return d.select("sample_id", D.parse_date_multi("date_text").alias("sample_date"))


def q_reject_split(spark, sf):
    from ..sources.rejects import split_rejects
    d = SI.dirty_text(spark, sf)
    parsed = d.select("sample_id", D.parse_date_multi("date_text").alias("sample_date"),
                      N.to_double_lenient("value_text").alias("value"))
    good, bad = split_rejects(parsed, {"sample_date": "unparseable date", "value": "unparseable number"})
    return rounded(good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad))


def q_epoch_date(spark, sf):
    o = SI.table(spark, sf, "orders")
    ms = (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400000
          + F.col("o_orderkey") % 86400000)
    e = o.select(F.col("o_orderkey").alias("sample_id"), ms.alias("time_start"))
    d = D.epoch_millis_to_date("time_start")
    lo, hi = D.window_bounds(d, 30)
    return e.select("sample_id", d.alias("image_date"), D.format_iso(d).alias("image_date_text"),
                    lo.alias("window_start"), hi.alias("window_end"))


def q_slug(spark, sf):
    p = SI.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("part_id"), T.slug("p_name").alias("slug"))


def q_unit_map(spark, sf):
    p = SI.parameter_rows(spark, sf)
    return p.select("sample_id", "parameter", T.unit_of("parameter").alias("unit"))


# ---------------------------------------------------------------- sources / sinks
def q_csv_round_trip(spark, sf):
    import uuid

    from ..session import checkpoint_dir
    from ..sources.csv_io import read_csv, write_csv
    s = SI.samples(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv_round_trip/{uuid.uuid4().hex}"
    write_csv(s, path)
    return rounded(read_csv(spark, path, s.schema))


def _ingested(spark, sf):
    from ..session import checkpoint_dir
    from .ingest import ingest
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/field-files/{uuid.uuid4().hex}"
    SI.field_lines(spark, sf).write.text(path)
    return ingest(spark, path)


def q_ingest_samples(spark, sf):
    """Samples that the front of the enrichment job lets through."""
    return rounded(_ingested(spark, sf).samples)


def q_ingest_rejects(spark, sf):
    """Rows that it turns away, with the reason (and the line, where it is malformed)."""
    return rounded(_ingested(spark, sf).rejects.drop("file"))


def q_ingest_counts(spark, sf):
    """Rows per outcome, counted while the tagged rows were written."""
    rows = [(k, int(v)) for k, v in _ingested(spark, sf).counts.items()]
    return spark.createDataFrame(rows, "outcome string, n long")


def q_pixel_from_lonlat(spark, sf):
    """10 m pixels of the stations, whose places are known in degrees."""
    from ..functions.geo import with_utm_forward
    from ..operators.scenes import pixel_keys
    s = with_utm_forward(SI.stations(spark, sf), "latitude", "longitude", 22, True, "x_m", "y_m")
    return pixel_keys(s, "x_m", "y_m").select("point", F.round("x_m", 3).alias("x_m"), F.round("y_m", 3).alias("y_m"),
                                              "px", "py")


def q_latest_snapshot(spark, sf):
    from ..operators.joins import latest_per_group
    e = SI.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return rounded(latest_per_group(e, ["user_id"], "ts"))


def q_resume_anti(spark, sf):
    from ..operators.joins import resume_pending
    docs = SI.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return resume_pending(docs, SI.table(spark, sf, "labels"), "doc_id")


# ---------------------------------------------------------------- joins
def q_lookup_left(spark, sf):
    from ..operators.joins import lookup_left
    docs = SI.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return lookup_left(docs, SI.table(spark, sf, "labels"), "doc_id")


def q_override_upsert(spark, sf):
    from ..operators.joins import override
    return rounded(override(SI.stations(spark, sf), SI.station_fixes(spark, sf), "point",
                            ["latitude", "longitude"]))


def q_harmonise_union(spark, sf):
    from ..operators.joins import harmonise_union
    return rounded(harmonise_union(SI.field_sources(spark, sf)))


def q_best_scene(spark, sf):
    from ..operators.scenes import best_scene
    from .enrich import STANDIN_CELL_DEG
    b = best_scene(SI.scene_samples(spark, sf), SI.scenes(spark, sf), cell_deg=STANDIN_CELL_DEG)
    return rounded(b.select("sample_id", "scene_id", "cloud_pct", "image_date"))


def q_cell_contains(spark, sf):
    from ..operators.scenes import containing_scenes
    from .enrich import STANDIN_CELL_DEG
    pairs = containing_scenes(SI.scene_samples(spark, sf), SI.scenes(spark, sf), cell_deg=STANDIN_CELL_DEG)
    return pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_scenes"))


def q_outline_contains(spark, sf):
    """Scenes over each sample, by their tilted outlines."""
    from ..operators.scenes import containing_outlines
    from .enrich import STANDIN_CELL_DEG
    pairs = containing_outlines(SI.scene_samples(spark, sf), SI.scene_footprints(spark, sf),
                                cell_deg=2 * STANDIN_CELL_DEG, refine=2)
    return pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_scenes"))


def q_pixel_sample(spark, sf):
    from ..operators.scenes import sample_pixels
    return rounded(sample_pixels(SI.pixel_points(spark, sf), SI.pixels(spark, sf))
                   .drop("x_m", "y_m"))


def q_scene_enrichment(spark, sf):
    from .enrich import enrichment_job
    return rounded(enrichment_job(spark, sf))


# ---------------------------------------------------------------- learning: exact pieces
def q_impute_median(spark, sf):
    from ..operators.learn import impute_median
    return rounded(impute_median(SI.bands(spark, sf), S.BANDS))


def q_standardise(spark, sf):
    from ..operators.learn import fit_scaler, hash_split, standardise
    b = hash_split(SI.bands(spark, sf), "sample_id")
    sc = fit_scaler(b.where(~F.col("is_test")), S.BANDS)
    return rounded(standardise(b, S.BANDS, sc))


def q_hash_split(spark, sf):
    from ..operators.learn import hash_split
    return hash_split(SI.samples(spark, sf).select("sample_id"), "sample_id")


def q_regression_metrics(spark, sf):
    return rounded(_model_metrics(spark, sf))


VALIDATION = {"Turbidez": "turbidity", "Clorofila a": "chlorophyll"}


def _validation_split(spark, sf, target, cloud=10):
    from ..operators.learn import hash_split
    from .train import preprocess
    prep, feats = preprocess(SI.training_rows(spark, sf), target, cloud_threshold=cloud, cloud_required=True)
    return hash_split(prep, "sample_id")


def q_ols_calibration(spark, sf):
    from .validate import calibrate
    rows = []
    for param, target in VALIDATION.items():
        s = _validation_split(spark, sf, target)
        c = calibrate(s.where(~F.col("is_test")), param)
        rows.append((param, int(c["n"]), c["slope"], c["intercept"], c["r2"]))
    return rounded(spark.createDataFrame(rows, "parameter string, n long, slope double, intercept double, r2 double"))


def q_calibrated_index(spark, sf):
    from .validate import calibrate
    s = _validation_split(spark, sf, "turbidity")
    c = calibrate(s.where(~F.col("is_test")), "Turbidez")
    raw = S.raw_estimator("Turbidez")
    t = s.where(F.col("is_test"))
    return rounded(t.select("sample_id", raw.alias("raw_index"),
                            S.calibrated(raw, F.lit(c["slope"]), F.lit(c["intercept"])).alias("calibrated")))


def q_index_validation(spark, sf):
    from .validate import validate
    out = None
    for param, target in VALIDATION.items():
        _, m, unit = validate(SI.training_rows(spark, sf), param, target, with_ml=False)
        m = m.select(F.lit(param).alias("parameter"), F.lit(unit).alias("unit"), "method", "r2", "rmse")
        out = m if out is None else out.unionByName(m)
    return rounded(out)


def q_index_validation_raw(spark, sf):
    """The index side without calibration."""
    from .validate import validate
    _, m, unit = validate(SI.training_rows(spark, sf), "Turbidez", "turbidity", with_ml=False, calibrate_index=False)
    return rounded(m.select(F.lit("Turbidez").alias("parameter"), F.lit(unit).alias("unit"), "method", "r2", "rmse"))


def _turbidity_train(spark, sf):
    s = _validation_split(spark, sf, "turbidity")
    return s.where(~F.col("is_test")).withColumn("raw_index", S.raw_estimator("Turbidez"))


def q_kfold_ols(spark, sf):
    from ..operators.learn import assign_folds, fold_linear_scores
    f = assign_folds(_turbidity_train(spark, sf), "sample_id", 5)
    return rounded(fold_linear_scores(f, ["raw_index"], "label", alpha=0.0))


def q_ridge_closed(spark, sf):
    from ..operators.learn import gram_stats, ridge_solve
    st = gram_stats(_turbidity_train(spark, sf), ["raw_index"], "label")[()]
    w, b = ridge_solve(st, 1.0)
    return rounded(spark.createDataFrame([(1.0, float(w[0]), float(b))], "alpha double, slope double, intercept double"))


def _cv_single(kind):
    def q(spark, sf):
        from ..operators.learn import assign_folds, gram_stats, linear_cv
        f = assign_folds(_turbidity_train(spark, sf), "sample_id", 5)
        st = gram_stats(f, ["raw_index"], "label", ["fold"])
        alpha, w, b = linear_cv({k[0]: v for k, v in st.items()}, kind)
        return rounded(spark.createDataFrame([(float(alpha), float(w[0]), float(b))],
                                             "alpha double, slope double, intercept double"))
    q.__doc__ = f"Alpha of a {kind} regression on the raw index by 5-fold search, and its refit."
    return q


def _cv_scores_single(kind):
    def q(spark, sf):
        from ..operators.learn import fold_r2_linear
        sc = fold_r2_linear(_turbidity_train(spark, sf), ["raw_index"], "label", kind, "sample_id")
        return rounded(spark.createDataFrame([(int(f), float(v)) for f, v in sc.items()], "fold int, r2 double"))
    q.__doc__ = f"Nested 5-fold R² of a {kind} regression on the raw index (alpha search inside each train part)."
    return q


q_ridge_cv_single, q_lasso_cv_single = _cv_single("ridge"), _cv_single("lasso")
q_ridge_cv_scores, q_lasso_cv_scores = _cv_scores_single("ridge"), _cv_scores_single("lasso")


def q_svr_linear(spark, sf):
    """Objective per row of the epsilon-insensitive regression on the raw index."""
    from ..operators.svr import fit_svr
    m = fit_svr(_turbidity_train(spark, sf), ["raw_index"], cost=1.0, epsilon=0.1, tol=1e-9)
    return spark.createDataFrame([(m.n, round(m.objective / m.n, 4))], "n long, objective_per_row double")


def q_validation_linear(spark, sf):
    """Test rows with Actual, a linear model on NDCI, the calibrated index and the six bands."""
    from .validate import validate
    out, _, _ = validate(SI.training_rows(spark, sf), "Turbidez", "turbidity", ml_kind="Linear", ml_features=["NDCI"])
    return rounded(out)


def _linear_run(spark, sf):
    from .train import train_models
    return train_models(SI.training_rows(spark, sf), "turbidity", models=["Linear"], features=["NDCI"])


def q_comparison_linear(spark, sf):
    """Comparison row of a linear model on NDCI."""
    from .train import comparison_frame
    return rounded(comparison_frame(spark, _linear_run(spark, sf)["rows"]).drop("error"))


def q_prediction_table(spark, sf):
    """Long table of a run's test predictions."""
    from .train import prediction_table
    return rounded(prediction_table(_linear_run(spark, sf)))


def q_cv_score_table(spark, sf):
    """Fold scores of a run."""
    from .train import cv_score_table
    return rounded(cv_score_table(spark, _linear_run(spark, sf)))


def q_row_index(spark, sf):
    """Samples with a 0-based index column in date, then key order."""
    from ..sources.csv_io import with_row_index
    return with_row_index(SI.samples(spark, sf).select("sample_id", "sample_date"), ["sample_date", "sample_id"])


LINEAR_FEATURES = {"NDCI": 40.0, "NDVI": -15.0, "MNDWI": 25.0}


def q_permutation_linear(spark, sf):
    """Permutation importance, 4 repeats, of a given linear predictor of turbidity."""
    from ..operators.importance import permutation_importance
    train = _turbidity_train(spark, sf).where(" AND ".join(f"{f} IS NOT NULL" for f in LINEAR_FEATURES))
    guess = sum((F.get("f", F.lit(i)) * w for i, w in enumerate(LINEAR_FEATURES.values())), F.lit(200.0))
    return rounded(permutation_importance(train, "sample_id", "label", list(LINEAR_FEATURES),
                                          lambda d: d.withColumn("prediction", guess), repeats=4))


def q_tree_exact(spark, sf):
    """Regression tree of depth 2 with exact thresholds on turbidity: its nodes."""
    from ..operators.tree import grow_tree
    nodes = grow_tree(_turbidity_train(spark, sf), ["NDCI", "MNDWI", "B8"], "label", max_depth=2, min_samples_split=20,
                      min_samples_leaf=5)
    return rounded(nodes)


# ---------------------------------------------------------------- learning: models (rows-only checks)
def _tm_split(spark, sf, target="turbidity"):
    from .train import preprocess, split_and_scale
    prep, feats = preprocess(SI.training_rows(spark, sf), target, cloud_threshold=20)
    train, test, _ = split_and_scale(prep, feats)
    return train, test, feats


def _model_query(kind):
    def q(spark, sf):
        from .train import fit_predict
        train, test, feats = _tm_split(spark, sf)
        pred, _ = fit_predict(kind, train, test, feats)
        return rounded(pred)
    q.__doc__ = f"Test-row predictions of the {kind} model (turbidity, cloud <= 20)."
    return q


q_rf_regression = _model_query("RandomForest")
q_gbt_regression = _model_query("GradientBoosting")
q_lasso_cv = _model_query("Lasso")
q_ridge_cv = _model_query("Ridge")
q_rff_huber = _model_query("RFFHuber")
q_svr_rbf = _model_query("SVR")


def q_kfold_rf(spark, sf):
    from .train import cv_scores
    train, _, feats = _tm_split(spark, sf)
    sc = cv_scores("RandomForest", train, feats)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(sc)], "fold int, r2 double")


def q_feature_importance(spark, sf):
    from .train import feature_importances, fit_predict
    train, test, feats = _tm_split(spark, sf)
    _, m = fit_predict("RandomForest", train, test, feats)
    return rounded(feature_importances(spark, m, feats))


def q_permutation_importance(spark, sf):
    from .train import fit_predict, permutation_importance
    train, test, feats = _tm_split(spark, sf)
    _, m = fit_predict("RandomForest", train, test, feats)
    return rounded(permutation_importance(m, train, feats))


def q_validation_assembly(spark, sf):
    """Test rows with Actual, ML_Predicted (forest), Index_Based (calibrated) and the six bands."""
    from .validate import validate
    out, _, _ = validate(SI.training_rows(spark, sf), "Turbidez", "turbidity", with_ml=True)
    return rounded(out)


def q_model_comparison(spark, sf):
    from .train import comparison_frame, train_models
    res = train_models(SI.training_rows(spark, sf), "turbidity", cloud_threshold=20)
    return rounded(comparison_frame(spark, res["rows"]))
