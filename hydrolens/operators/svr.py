"""Support-vector regression: epsilon-insensitive loss, L2 penalty, cost C.

minimise  1/2 |w|^2 + C * sum(max(0, |y - w.z - b| - epsilon))

over features z: the given columns (linear) or random Fourier features of an RBF
kernel.  The loss is smoothed to a quadratic within C * mu of its corners, where
it has a second derivative; Newton steps minimise it.  A step takes two aggregates
over the rows: loss, gradient and curvature are sums, and so are the losses at all
lengths of a step.  mu falls until the duality gap of the true problem is below
``tol`` of its objective; the rows' multipliers, scaled so that they add to zero,
give the dual value in the same aggregate.  If ``max_passes`` do not reach the gap,
that is an error, never an unfinished model.

Only the sums (features squared at most) reach the driver.  The rows are stored
once as one array column; a pass reads them, moves nothing and keeps nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


@dataclass
class FeatureMap:
    """Random Fourier features z = sqrt(2/D) cos(xW + c), or x itself."""
    w: np.ndarray | None = None
    c: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return x
        return math.sqrt(2.0 / self.w.shape[1]) * np.cos(x @ self.w + self.c)


def rbf_map(p: int, n_components: int = 100, gamma: float | None = None, seed: int = 42) -> FeatureMap:
    """Approximates exp(-gamma |x - x'|^2); gamma defaults to 1/p, which is the
    usual scale rule on standardised inputs."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * (gamma if gamma is not None else 1.0 / p)), size=(p, n_components))
    return FeatureMap(w, rng.uniform(0, 2 * math.pi, size=n_components))


@dataclass
class SVRModel:
    features: list[str]
    map: FeatureMap
    w: np.ndarray
    b: float
    objective: float
    gap: float
    passes: int
    n: int

    def as_scalars(self) -> dict:
        """Everything that makes the model, as numbers and lists."""
        m = self.map
        return {"features": self.features, "w": self.w.tolist(), "b": self.b, "objective": self.objective,
                "gap": self.gap, "map_w": m.w.tolist() if m.w is not None else None,
                "map_c": m.c.tolist() if m.c is not None else None}

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with predictions (one product per Arrow batch); a row with a
        missing feature has none."""
        model, x = self, F.array(*[F.col(f"`{f}`").cast("double") for f in self.features])
        if self.map.w is None:
            terms = [F.col(f"`{f}`").cast("double") * float(c) for f, c in zip(self.features, self.w)]
            return df.withColumn(out, sum(terms, F.lit(float(self.b))))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                xs = _array(t.column("_hl_x"))
                y = model.map(xs) @ model.w + model.b
                missing = np.isnan(xs).any(axis=1)
                cols = [t.column(i) for i in range(t.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(y, mask=missing)], names=[*t.schema.names[:-1], out])
        base = df.drop(out)
        schema = base.withColumn(out, F.lit(None).cast("double")).schema
        return base.withColumn("_hl_x", x).mapInArrow(score, schema)


def _array(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


#: lengths of a step that are tried at once
STEPS = [0.4 ** i for i in range(28)]


def _sums(rows: DataFrame, of_batch) -> np.ndarray:
    """Sum over all rows of ``of_batch(x, y)``, an array of fixed length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in batches:
            if t.num_rows:
                got = of_batch(_array(t.column("x")), t.column("y").to_numpy(zero_copy_only=False))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])
    got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one fixed-length array
    return np.array([v for _, v in sorted((r["i"], r["v"]) for r in got)])


def _smooth(over: np.ndarray, mu: float, cost: float) -> float:
    return float(np.where(over < cost * mu, over * over / (2 * mu), cost * over - cost * cost * mu / 2).sum())


def _at(rows: DataFrame, z: FeatureMap, theta: np.ndarray, mu: float, cost: float, eps: float) -> dict:
    """Loss, gradient, curvature and duality gap at ``theta`` = (w, b)."""
    k = len(theta)
    upper = np.triu_indices(k)

    def sums(x, y):
        f = np.c_[z(x), np.ones(len(y))]
        r = y - f @ theta
        over = np.maximum(np.abs(r) - eps, 0.0)
        a = np.sign(r) * np.minimum(over / mu, cost)
        up = np.maximum(a, 0.0)
        g = f[(over > 0) & (over < cost * mu)]
        return np.r_[_smooth(over, mu, cost), over.sum(), a @ y, up @ y, np.abs(a).sum(), a @ f, up @ f, (g.T @ g)[upper]]
    v = _sums(rows, sums)
    smooth, over, ay, uy, size = v[:5]
    moved, up, tail = v[5:5 + k], v[5 + k:5 + 2 * k], v[5 + 2 * k:]
    hess = np.zeros((k, k))
    hess[upper] = tail
    hess = hess + np.triu(hess, 1).T
    # multipliers must add to zero: shorten those of the side that has too much
    side, side_y = (up, uy) if moved[-1] > 0 else (moved - up, ay - uy)
    cut = moved[-1] / side[-1] if moved[-1] else 0.0
    free = moved - cut * side
    dual = ay - cut * side_y - eps * (size - cut * abs(side[-1])) - 0.5 * free[:-1] @ free[:-1]
    penalty, primal = 0.5 * theta[:-1] @ theta[:-1], 0.5 * theta[:-1] @ theta[:-1] + cost * over
    return {"smooth": float(penalty + smooth), "primal": float(primal), "gap": float(primal - dual),
            "grad": np.r_[theta[:-1], 0.0] - moved, "curved": float(hess[-1, -1]),
            "hess": hess / mu + np.diag([1.0] * (k - 1) + [0.0])}


def _along(rows: DataFrame, z: FeatureMap, theta, step, mu: float, cost: float, eps: float) -> np.ndarray:
    """Smoothed objective after each of ``STEPS``."""
    def sums(x, y):
        f = np.c_[z(x), np.ones(len(y))]
        r, d = y - f @ theta, f @ step
        return np.array([_smooth(np.maximum(np.abs(r - t * d) - eps, 0.0), mu, cost) for t in STEPS])
    ends = [theta[:-1] + t * step[:-1] for t in STEPS]
    return _sums(rows, sums) + np.array([0.5 * w @ w for w in ends])


def fit_svr(df: DataFrame, features, label: str = "label", cost: float = 1.0, epsilon: float = 0.1,
            feature_map: FeatureMap | None = None, tol: float = 1e-5, max_passes: int = 300) -> SVRModel:
    """Fit on the rows of ``df`` that have the label and all features."""
    features, z = list(features), feature_map or FeatureMap()
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    rows = df.select(x.alias("x"), F.col(f"`{label}`").cast("double").alias("y")).where(
        F.col("y").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c)))
    rows = stored(rows, "svr")
    s = rows.agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.stddev_pop("y").alias("sd")).first()
    if not s["n"]:
        raise ValueError("no row with a label and all features")
    k = (z.w.shape[1] if z.w is not None else len(features)) + 1
    theta = np.zeros(k)
    theta[-1] = s["m"]
    spread = max(s["sd"] or 0.0, epsilon, 1e-9)
    mu = spread / cost
    at = _at(rows, z, theta, mu, cost, epsilon)
    for passes in range(1, max_passes + 1):
        enough = tol * max(at["primal"], 1e-12)
        if at["gap"] <= enough:
            return SVRModel(features, z, theta[:-1], float(theta[-1]), at["primal"], max(at["gap"], 0.0), passes, s["n"])
        damp = 1e-9 * max(1.0, float(np.trace(at["hess"])) / k) + 1e-6 * s["n"] * cost / spread
        step = -np.linalg.solve(at["hess"] + damp * np.eye(k), at["grad"])
        moved = False
        # what smoothing costs is about curved * cost^2 * mu / 2: below that, narrow it
        if -float(at["grad"] @ step) > 0.01 * cost * cost * mu * (at["curved"] + 1):
            losses = _along(rows, z, theta, step, mu, cost, epsilon)
            best = int(np.argmin(losses))
            moved = losses[best] < at["smooth"]
        if moved:
            theta = theta + STEPS[best] * step
        else:
            mu /= 4
        at = _at(rows, z, theta, mu, cost, epsilon)
    raise RuntimeError(f"no duality gap below {tol:g} after {max_passes} steps (gap {at['gap']:g} of {at['primal']:g})")
