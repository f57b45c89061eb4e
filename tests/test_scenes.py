"""Best scene in a window: boundaries and ties, against a brute-force statement."""

import datetime as dt
import random

import pytest

from hydrolens.operators.scenes import best_scene, containing_scenes

D0 = dt.date(2024, 3, 1)
T = lambda days, hours=0: dt.datetime(2024, 3, 1) + dt.timedelta(days=days, hours=hours)

SAMPLES = [(1, D0, -51.0, -18.0), (2, D0, -51.0, -18.0), (3, D0, -40.0, -10.0), (4, D0, -51.2, -18.2)]
SCENES = [  # scene_id, min_lon, min_lat, max_lon, max_lat, acquired_at, cloud
    (10, -51.2, -18.2, -50.8, -17.8, T(-30), 5.0),          # exactly date-30 00:00: inside
    (11, -51.2, -18.2, -50.8, -17.8, T(30), 1.0),           # exactly date+30 00:00: outside
    (12, -51.2, -18.2, -50.8, -17.8, T(29, 23), 5.0),       # same cloud as 10, further in time
    (13, -51.2, -18.2, -50.8, -17.8, T(-31, 23), 0.0),      # just before the window
    (14, -51.1, -18.1, -50.9, -17.9, T(3), 5.0),            # same cloud, closest in time -> wins
    (15, -60.0, -30.0, -59.0, -29.0, T(0), 0.0),            # elsewhere
]


def _brute(samples, scenes, w=30):
    out = {}
    for sid, d, lon, lat in samples:
        lo, hi = dt.datetime.combine(d, dt.time()) - dt.timedelta(days=w), dt.datetime.combine(d, dt.time()) + dt.timedelta(days=w)
        c = [(cl, abs((at - dt.datetime.combine(d, dt.time())).total_seconds()), sc)
             for sc, x0, y0, x1, y1, at, cl in scenes
             if x0 <= lon <= x1 and y0 <= lat <= y1 and lo <= at < hi]
        out[sid] = min(c)[2] if c else None
    return out


def _frames(spark):
    s = spark.createDataFrame(SAMPLES, "sample_id long, sample_date date, longitude double, latitude double")
    sc = spark.createDataFrame(SCENES, "scene_id long, min_lon double, min_lat double, max_lon double, "
                                       "max_lat double, acquired_at timestamp_ntz, cloud_pct double")
    return s, sc


def test_best_scene_boundaries(spark):
    s, sc = _frames(spark)
    for cell in (0.05, 0.25, 1.0):
        got = {r["sample_id"]: r["scene_id"] for r in best_scene(s, sc, cell_deg=cell).collect()}
        assert got == _brute(SAMPLES, SCENES), cell
    assert _brute(SAMPLES, SCENES)[1] == 14 and _brute(SAMPLES, SCENES)[3] is None


def test_edge_point_is_inside(spark):
    s, sc = _frames(spark)
    pairs = {(r["sample_id"], r["scene_id"]) for r in containing_scenes(s, sc, cell_deg=0.1).collect()}
    assert (4, 10) in pairs and (4, 14) not in pairs


def test_repartition_invariance(spark):
    s, sc = _frames(spark)
    a = sorted(map(tuple, best_scene(s, sc).select("sample_id", "scene_id").collect()))
    b = sorted(map(tuple, best_scene(s.repartition(3), sc.repartition(5)).select("sample_id", "scene_id").collect()))
    assert a == b


@pytest.mark.parametrize("window, cell", [(30, 0.06), (1, 0.06), (0, 0.25), (45, 1.0)])
def test_best_scene_copies_few_rows(spark, monkeypatch, window, cell):
    """Right beside tile and bucket borders, and without a copy of a row for every cell and bucket."""
    rng = random.Random(7)
    samples = [(i, dt.date(1969, 11, 1) + dt.timedelta(days=rng.randrange(150)), rng.randrange(-30, 30) * 0.05,
                rng.randrange(-30, 30) * 0.05) for i in range(500)]
    scenes = []
    for i in range(600):
        x, y = rng.randrange(-30, 30) * 0.05, rng.randrange(-30, 30) * 0.05
        at = dt.datetime(1969, 11, 1) + dt.timedelta(days=rng.randrange(-30, 180), hours=rng.choice([0, 0, 5, 23]))
        scenes.append((i, x - 0.12, y - 0.12, x + 0.12, y + 0.12, at, float(rng.randrange(4))))
    s = spark.createDataFrame(samples + [(900, None, 0.0, 0.0), (901, samples[0][1], None, 0.0)], _frames(spark)[0].schema)
    sc = spark.createDataFrame(scenes + [(-1, None, -0.5, 0.5, 0.5, T(0), 0.0), (-2, -0.5, -0.5, 0.5, 0.5, None, 0.0)],
                               _frames(spark)[1].schema)
    met, join = [], type(s).join
    monkeypatch.setattr(type(s), "join", lambda left, right, *a, **k: met.append((left, right)) or join(left, right, *a, **k))
    out = best_scene(s, sc, window_days=window, cell_deg=cell)
    monkeypatch.undo()
    assert {r["sample_id"]: r["scene_id"] for r in out.collect()} == _brute(samples, scenes, window) | {900: None, 901: None}
    left, right = met[0]
    assert left.count() <= 2 * len(samples) + 2 and right.count() < 3 * len(scenes)


def test_incremental_enrichment_resumes(spark, tmp_path):
    """Two runs over a growing folder: each sample is enriched exactly once."""
    from hydrolens.plans.enrich import enrich
    from hydrolens.streaming.incremental import start_incremental_enrichment
    s, sc = _frames(spark)
    pixels = spark.createDataFrame([(10, 0, 0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)],
                                   "scene_id long, px long, py long, B2 double, B3 double, B4 double, "
                                   "B5 double, B8 double, B11 double")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    s.where("sample_id <= 2").write.parquet(src + "/a")
    q = start_incremental_enrichment(spark, src + "/*", s.schema, sc, pixels, out, query_name="t1")
    q.awaitTermination()
    s.where("sample_id > 2").write.parquet(src + "/b")
    q = start_incremental_enrichment(spark, src + "/*", s.schema, sc, pixels, out, query_name="t1")
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r[0] for r in got.select("sample_id").collect()) == [1, 2, 3, 4]
    assert got.count() == enrich(s, sc, pixels).count()
