"""The last-run pivot against a plain loop, with many small ranges."""

import random

import pytest

from hydrolens.operators import ordered, reshape


@pytest.mark.parametrize("seed", [1, 2])
def test_last_run_wins(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 20)
    rng, rows, key = random.Random(seed), [], "a"
    for i in range(300):
        key = rng.choice([None, "a", "b", "c"]) if rng.random() < 0.3 else key
        label = rng.choice(["x", "y", "z", None] if i > 50 else ["x", "q"])
        rows.append((i, key, label, None if rng.random() < 0.2 else float(i), f"u{i}"))
    df = spark.createDataFrame(rows, "ord long, k string, p string, v double, u string").repartition(4)
    got = {r["k"]: r.asDict() for r in reshape.pivot_last_run(df, ["k"], "ord", "p", "v", "u").collect()}
    want, before = {}, object()
    for _, k, p, v, u in rows:
        if k != before:
            want[k] = {}
        before = k
        if p is not None:
            want[k] |= {p: v, f"{p}_UN": u}
    columns = [c for p in ("q", "x", "y", "z") for c in (p, f"{p}_UN")]
    assert set(got) == set(want)
    assert all(got[k][c] == want[k].get(c) for k in want for c in columns)
