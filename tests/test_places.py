"""Outlines, projection, binned densities and the ingest front against plain restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolens.functions.geo import with_utm_forward, with_utm_inverse
from hydrolens.operators.profile import binned_kde
from hydrolens.operators.scenes import cells_of_outlines, containing_outlines
from hydrolens.plans.ingest import FIELDS, ingest


def _inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


@pytest.mark.parametrize("cell, refine", [(0.25, 4), (1.0, 8), (5.0, 2)])
def test_points_in_outlines(spark, cell, refine):
    rings = {1: [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (0.5, 0.5), (-1.0, 2.0)],  # a notch
             2: [(0.0, 0.0), (3.0, 0.25), (1.0, 1.75)], 3: [(0.0, 0.0), (1.0, 1.0)],
             4: [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0), (-1.0, -1.0)]}  # closed
    points = [(i, x / 8, y / 8) for i, (x, y) in enumerate((x, y) for x in range(-12, 28) for y in range(-12, 20))]
    outlines = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in r]) for k, r in rings.items()],
                                     "scene_id long, ring array<struct<lon:double,lat:double>>")
    samples = spark.createDataFrame(points + [(9999, None, 1.0)], "sample_id long, longitude double, latitude double")
    got = [tuple(r) for r in containing_outlines(samples, outlines, cell_deg=cell, refine=refine).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, k) for i, x, y in points for k, r in rings.items() if len(r) > 2 and _inside(x, y, r)}


def test_forward_then_inverse(spark):
    rows = [(float(a), -51.0 + b) for a in range(-80, 0, 7) for b in (-3.0, -0.4, 0.0, 2.9)] + [(None, 1.0), (-90.0, -51.0)]
    df = spark.createDataFrame(rows, "Latitude double, Longitude double")
    there = with_utm_forward(df, "Latitude", "Longitude", 22, True, "X", "Y")
    back = with_utm_inverse(there.withColumnsRenamed({"Latitude": "a", "Longitude": "b"}), "X", "Y", 22, True).collect()
    for r in back[:-2]:
        assert r["Latitude"] == pytest.approx(r["a"], abs=1e-8) and r["Longitude"] == pytest.approx(r["b"], abs=1e-8)
    assert all(r["X"] is None for r in back[-2:])
    # the central meridian lies at 500 km; a degree north of the equator's meridian arc is known
    one = with_utm_forward(spark.createDataFrame([(1.0, -51.0)], "Latitude double, Longitude double"), south=False).first()
    assert one["X"] == pytest.approx(500000.0, abs=1e-6) and one["Y"] == pytest.approx(0.9996 * 110574.3886, abs=0.05)


def test_binned_density_is_close_to_the_direct_sum(spark):
    rng = np.random.default_rng(2)
    vs = {"a": rng.normal(size=700), "b": np.r_[rng.normal(size=60), 400.0], None: rng.uniform(size=90), "c": [3.0] * 5}
    rows = [(g, float(v)) for g, xs in vs.items() for v in xs] + [("a", None), ("d", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["i"]): r for r in binned_kde(df, "v", ["g"], grid=60).collect()}
    assert {g for g, _ in got} == {"a", "b", None} and len(got) == 180
    for g in ("a", "b", None):
        v = np.asarray(vs[g])
        h = v.std(ddof=1) * len(v) ** -0.2
        for i in range(60):
            x = v.min() + i * (v.max() - v.min()) / 59
            want = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
            assert got[g, i]["x"] == pytest.approx(x) and abs(got[g, i]["density"] - want) < 1e-6 / h
    assert binned_kde(df.where("g = 'a'"), "v", grid=60).count() == 60
    assert binned_kde(df.where("false"), "v", ["g"]).count() == 0


def test_ingest_keeps_every_line(spark, tmp_path):
    lines = ["1;2/3/2020;1,5;-18;-45", "2;2020-03-02;2.5;-18;-45;extra", "x;2020-03-02;1;0;0", "4;never;1;0;0", "5;2020-03-02;n/a;0;0",
             "6;2020-03-02;1;95;0", "7;2020-03-02", '8;2020-03-02;"3,25";90;180', "9;2020-03-02;1;;"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(lines[:5]) + "\n")
    (tmp_path / "in" / "b.csv").write_text("\n".join(lines[5:]) + "\n")
    out = ingest(spark, str(tmp_path / "in"))
    good = {r["sample_id"]: r["value"] for r in out.samples.collect()}
    assert good == {1: 1.5, 8: 3.25} and out.samples.columns == FIELDS
    bad = out.rejects.collect()
    assert len(bad) == 7 and {r["malformed"] for r in bad if r["malformed"]} == {lines[1], lines[6]}
    assert {r["file"].rsplit("/", 1)[1] for r in bad} == {"a.csv", "b.csv"}
    assert out.counts == {"kept": 2, "malformed line": 2, "missing key": 1, "unparseable date": 1, "unparseable number": 1,
                          "outside the globe": 2}
    assert sum(out.counts.values()) == len(lines)
    assert out.rejects.where(F.col("reject_reason") == "outside the globe").count() == 2


def test_border_cells_carry_only_the_edges_that_decide(spark):
    ring = [{"lon": math.cos(2 * math.pi * i / 60), "lat": math.sin(2 * math.pi * i / 60)} for i in range(60)]
    outlines = spark.createDataFrame([(1, ring)], "scene_id long, ring array<struct<lon: double, lat: double>>")
    _, fine = cells_of_outlines(outlines, 0.25, 4)
    assert max(r["n"] for r in fine.where("border").select(F.size("edges").alias("n")).collect()) <= 20
    rng = random.Random(5)
    points = [(i, rng.uniform(-1.1, 1.1), rng.uniform(-1.1, 1.1)) for i in range(400)]
    points += [(400 + i, x, y) for i, x, y in points] + [(900, None, 0.5)]
    samples = spark.createDataFrame(points, "sample_id long, longitude double, latitude double")
    got = sorted(r["sample_id"] for r in containing_outlines(samples, outlines, cell_deg=0.25, refine=4).collect())
    a = math.pi / 60
    inside = lambda x, y: all(x * math.cos(2 * a * i + a) + y * math.sin(2 * a * i + a) < math.cos(a)
                              for i in range(60))
    assert got == [i for i, x, y in points[:800] if inside(x, y)]
