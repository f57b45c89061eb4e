"""Mixing sources to target weights with soft domain membership.

1. A multinomial logistic regression over hashed words and a few shape measures
   learns domains from the ``labels`` table (at most ``SAMPLE_ROWS`` labelled
   documents a domain, drawn by hash) and gives every document its posterior
   over the domains.
   The sample's domain shares are not the table's, so the log of each domain's
   sampling share is taken off its bias: the posteriors carry the prior of the
   whole label table at every size.
2. Every document gets a rate r >= 0, its expected number of copies, by
   least squares: with n tokens, posterior p and T(k) the sum of r n p(k),
   minimise
       sum_k (T(k) - target(k))^2 / T0(k)  +  ridge * sum n (r - 1)^2
   where T0 are the totals at r = 1.  At the minimum the projected gradient
   sum_k p(k) e(k) + ridge (r - 1) with e(k) = (T(k) - target(k)) / T0(k) is
   zero, so r = max(0, 1 - sum_k p(k) u(k)) with u = e / ridge: as many unknowns
   as domains.  They minimise the convex dual
       ridge / 2 sum T0 u^2 + sum target u + 1/2 sum n max(0, 1 - p u)^2
   which is piecewise quadratic, by Newton steps, halved when the dual doesn't
   fall.  One aggregate a step gives totals and K x K Hessian; a document's rate
   is computed from u, so no rate is stored or shuffled.  The fit ends when the
   gradient is at most TOLERANCE of all tokens and raises an error otherwise.

Defined results: a null text has no tokens and the prior posterior; label rows
with neither value, or for unknown documents, are not used; without usable
labels there is one domain ``all``; a domain without a target or without tokens
has no term; rows that repeat a doc_id are rows of their own; extra columns are
carried untouched by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import arrow_batches, packed, stored, table, unpacked

#: labelled documents a domain that the classifier is fitted on, about
SAMPLE_ROWS = 2000
HASH_BITS = 16
TARGETS = {"good": 0.90, "poor": 0.07, "toxic": 0.03}
RIDGE = 1e-3
#: a gradient of at most this share of all tokens is the optimum
TOLERANCE = 1e-9
#: more aggregates than this are an error
STEPS = 200
N_SHAPES = 5
#: the sample is drawn by a hash of the id into so many equal draws
DRAWS = 1 << 40

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_IS_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_IS_SYMBOL = np.array([33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in range(256)])


def domain_of(labels: DataFrame) -> Column:
    return (F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
            .when((F.col("quality") == 0) | (F.col("toxic") == 0), "poor"))


# -- features ---------------------------------------------------------------------------------
def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, hashed distinct words with their text, and shapes."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(raw)
    a = np.frombuffer(b"".join(b"%b\n" % r.translate(_FOLD) for r in raw) + bytes(8), np.uint8)
    size = np.array([len(r) + 1 for r in raw], np.int64)
    first = np.cumsum(size) - size
    gap = (a == 32) | (a == 10) | (a == 0)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    w = np.ndarray((len(a) - 7,), "<u8", a, strides=(1,))
    length = ends - starts
    short = np.minimum(length, 8).astype(np.uint64)
    head = w[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short))
    tail = np.where(length > 8, w[np.maximum(ends - 8, 0)], np.uint64(0))
    h = (head * np.uint64(0x9E3779B97F4A7C15) ^ tail * np.uint64(0xC2B2AE3D27D4EB4F) ^ length.astype(np.uint64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - HASH_BITS)
    doc = np.searchsorted(first, starts, "right") - 1
    n_words = np.bincount(doc, minlength=n)
    again = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
    pairs = np.unique(doc.astype(np.uint64) << np.uint64(HASH_BITS) | h)
    # shapes of the raw bytes
    flat = np.frombuffer(b"".join(b"%b\n" % r for r in raw), np.uint8)
    per = lambda m: np.add.reduceat(m.astype(np.int32), first) if n else np.zeros(0)
    kinds = np.bincount((pairs >> np.uint64(HASH_BITS)).astype(np.int64), minlength=n)
    some = np.maximum(n_words, 1)
    shapes = np.stack([per(_IS_UPPER[flat]) / size, per(_IS_SYMBOL[flat]) / size,
                       np.bincount(doc[again], minlength=n) / some, kinds / some,
                       np.log1p(n_words) / 10], axis=1)
    return n_words, (pairs >> np.uint64(HASH_BITS)).astype(np.int64), \
        (pairs & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64), shapes


def _scores(weights, shape_weights, bias, n, doc, word, shapes) -> np.ndarray:
    kinds = np.bincount(doc, minlength=n)
    out = np.zeros((n, len(bias)))
    has = np.flatnonzero(kinds)
    if len(word):
        out[has] = np.add.reduceat(weights[word], np.r_[0, np.cumsum(kinds[has])[:-1]], axis=0)
        out[has] /= np.sqrt(kinds[has])[:, None]
    out += shapes @ shape_weights + bias
    out -= out.max(axis=1, keepdims=True)
    e = np.exp(out)
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int, epochs: int = 12, rate: float = 0.05, seed: int = 5):
    """Softmax regression by Adam on mini-batches; rows: (class, words, shapes)."""
    rng = np.random.default_rng(seed)
    par = [np.zeros((1 << HASH_BITS, k)), np.zeros((N_SHAPES, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 128):
            part = [rows[i] for i in order[a:a + 128]]
            n = len(part)
            size = np.array([len(r[1]) for r in part])
            doc, word = np.repeat(np.arange(n), size), np.concatenate([r[1] for r in part]).astype(np.int64)
            shapes = np.stack([r[2] for r in part])
            d = _scores(*par, n, doc, word, shapes)
            d[np.arange(n), [r[0] for r in part]] -= 1
            d /= n
            used, which = np.unique(word, return_inverse=True)
            g = np.zeros((len(used), k))
            np.add.at(g, which, (d / np.sqrt(np.maximum(size, 1))[:, None])[doc])
            t += 1
            for i, (at, grad) in enumerate([(used, g), (slice(None), shapes.T @ d), (slice(None), d.sum(axis=0))]):
                m[i][at] = 0.9 * m[i][at] + 0.1 * grad
                v[i][at] = 0.99 * v[i][at] + 0.01 * grad * grad
                par[i][at] -= rate * (m[i][at] / (1 - 0.9 ** t)) / (np.sqrt(v[i][at] / (1 - 0.99 ** t)) + 1e-6)
    return par


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, doc, word, shapes = features(b.column(1).to_pylist())
        cut = np.searchsorted(doc, np.arange(1, b.num_rows))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([w.astype("<u2").tobytes() for w in np.split(word, cut)], pa.binary()),
             pa.array([s.astype("<f8").tobytes() for s in shapes], pa.binary())], names=["domain", "words", "shapes"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(domains, parameters) of the classifier."""
    labelled = labels.select(F.col("doc_id").alias("_id"), domain_of(labels).alias("domain")).where(
        "domain IS NOT NULL AND _id IS NOT NULL")
    counts = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    if not counts:
        return ["all"], None
    # whole draws, so that these are the very shares that are drawn
    drawn_share = {d: min(DRAWS, math.ceil(sample_rows / n * DRAWS)) / DRAWS for d, n in counts.items()}
    share = F.coalesce(*[F.when(F.col("domain") == d, F.lit(drawn_share[d])) for d in sorted(counts)])
    # at most about sample_rows a domain, so this side is bounded
    drawn = labelled.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(DRAWS)) < share * DRAWS)
    got = (docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("domain", "text")
           .mapInArrow(_sample_features, "domain string, words binary, shapes binary").collect())
    domains = sorted({r["domain"] for r in got})
    if not domains:
        return ["all"], None
    at = {d: k for k, d in enumerate(domains)}
    rows = sorted(((at[r["domain"]], bytes(r["words"]), bytes(r["shapes"])) for r in got))
    par = fit([(k, np.frombuffer(w, "<u2"), np.frombuffer(s, "<f8")) for k, w, s in rows], len(domains))
    par[2] -= np.log([drawn_share[d] for d in domains])
    return domains, par


def _posterior_task(domains: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        par = shared.value
        for b in batches:
            k = b.schema.names.index("text")
            keep = [i for i in range(b.num_columns) if i != k]
            n_words, doc, word, shapes = features(b.column(k).to_pylist())
            p = _scores(*par, b.num_rows, doc, word, shapes) if par else np.ones((b.num_rows, 1))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(n_words, pa.int64()), *(pa.array(c) for c in p.T)],
                names=[*(b.schema.names[i] for i in keep), "n_tokens", *(f"p_{d}" for d in domains)])
    return run


def posteriors(docs: DataFrame, domains: list[str], par) -> DataFrame:
    """``docs`` (must hold ``text``) without the text, with n_tokens and p_<domain>."""
    schema = StructType([f for f in docs.schema.fields if f.name != "text"]
                        + [StructField("n_tokens", LongType())] + [StructField(f"p_{d}", DoubleType()) for d in domains])
    return docs.mapInArrow(_posterior_task(domains, docs.sparkSession.sparkContext.broadcast(par)), schema)


# -- rates ------------------------------------------------------------------------------------
def _rate(domains: list[str], pull: dict[str, float]) -> Column:
    """The best rate under the scaled residuals ``pull`` (residual / ridge)."""
    return F.greatest(F.lit(0.0), sum((F.col(f"p_{d}") * F.lit(-pull[d]) for d in domains if d in pull), F.lit(1.0)))


def fit_rates(scored: DataFrame, domains: list[str], targets: dict[str, float], ridge: float = RIDGE,
              steps: int = STEPS) -> tuple[Column, dict[str, float], dict[str, float]]:
    """(rate column, target tokens, expected tokens at these rates); an error
    if the optimum isn't reached in ``steps`` aggregates."""
    def sums(pull, ds):
        """Totals, dual part and Hessian part at the rates under ``pull``."""
        n, r = F.col("n_tokens"), F.col("_r")
        pairs = [(x, y) for i, x in enumerate(ds) for y in ds[i:]]
        got = scored.select("n_tokens", *[f"p_{d}" for d in domains], _rate(domains, pull).alias("_r")).agg(
            F.sum(n * r * r).alias("dual"), *[F.sum(n * F.col(f"p_{d}") * r).alias(f"t_{d}") for d in domains],
            *[F.sum(F.when(r > 0, n * F.col(f"p_{x}") * F.col(f"p_{y}"))).alias(f"h_{ds.index(x)}_{ds.index(y)}")
              for x, y in pairs]).first()
        h = np.zeros((len(ds), len(ds)))
        for x, y in pairs:
            i, j = ds.index(x), ds.index(y)
            h[i, j] = h[j, i] = got[f"h_{i}_{j}"] or 0.0
        return {d: got[f"t_{d}"] or 0.0 for d in domains}, got["dual"] or 0.0, h
    base, _, _ = sums({}, [])
    every = sum(base.values())
    asked = {d: targets[d] for d in domains if targets.get(d) is not None and base[d] > 0}
    want = {d: every * w / sum(asked.values()) for d, w in asked.items()} if sum(asked.values()) > 0 else {}
    if not want:
        return _rate(domains, {}), want, base
    ds = list(want)
    t0, goal = np.array([base[d] for d in ds]), np.array([want[d] for d in ds])

    def at(u):
        """Dual value over ridge, its gradient and Hessian, and the totals."""
        now, dual, h = sums(dict(zip(ds, map(float, u))), ds)
        value = ridge * (t0 * u * u).sum() / 2 + (goal * u).sum() + dual / 2
        grad = ridge * t0 * u + goal - np.array([now[d] for d in ds])
        return value, grad, np.diag(ridge * t0) + h, now
    u, size = np.zeros(len(ds)), 1.0
    value, grad, hess, now = at(u)
    for _ in range(steps):
        if np.abs(grad).max() <= TOLERANCE * every:
            return _rate(domains, dict(zip(ds, map(float, u)))), want, now
        move = -np.linalg.solve(hess, grad)
        v, g, h, t = at(u + size * move)
        slope = size * float(grad @ move)
        if v <= value + 1e-4 * slope + 1e-13 * abs(value) or np.abs(g).max() < 0.5 * np.abs(grad).max():
            u, size, value, grad, hess, now = u + size * move, 1.0, v, g, h, t
        else:
            size /= 2
    raise RuntimeError(f"op2_mixing: rates not fitted after {steps} steps; "
                       f"gradient {np.abs(grad).max() / every:.1e} of all tokens, reached {now}, wanted {want}")


def copies_of(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as their expectation, fixed by the key."""
    draw = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def _fitted(docs: DataFrame, source: DataFrame, labels: DataFrame, targets: dict[str, float]):
    arrow_batches(docs.sparkSession)
    domains, par = train(source, labels)
    scored = stored(posteriors(docs, domains, par), "posteriors", "zstd")
    rate, _, _ = fit_rates(scored, domains, targets)
    return scored, domains, rate


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Each document in as many copies as its rate says; columns as they were."""
    scored, _, rate = _fitted(packed(docs, "text"), docs.select("doc_id", "text"), labels, targets or TARGETS)
    taken = scored.withColumn("_copies", copies_of(rate, F.col("doc"))).where("_copies > 0")
    return unpacked(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, domains, rate = _fitted(docs, docs, table(spark, sf_dir, "labels"), TARGETS)
    return (scored.select("doc_id", "n_tokens", *[f"p_{d}" for d in domains], rate.alias("rate"))
            .withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"))))
