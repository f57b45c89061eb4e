"""Regression forest of deep trees, grown and scored in pieces.

A tree without a depth limit has about as many leaves as the table has rows, so
neither one histogram per node (a shuffle of all bins for every node, however
few its rows) nor one task or the driver may hold the work:

* features are cut into at most ``max_bins`` bins at quantiles of all rows, a row
  is one byte per feature;
* nodes of more than ``PIECE`` rows are split level by level from histograms,
  one pass over the rows and one small shuffle per level for all trees;
* every smaller node goes with its rows to one task, which grows what is below
  it.  These pieces of at most ``PIECE`` rows are written to the shared folder;
  the driver only knows the few nodes above them;
* rows are scored in blocks: a task reads a bounded number of trees, then one
  block after the other, and writes the trees' sums, which are added per block.

A row's part in a tree (a Poisson(1) draw) depends on the seed, the tree and the
row's number in the order of its values, never on how the rows are partitioned.
Splits are the best by variance, first feature and lowest cut on ties.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordered import row_number

# the functions below run on executors that lack this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows of a node that one task grows
PIECE = 1 << 20
#: nodes of so many rows are searched row by row; rows and histogram cells searched at a time, so that they stay in the processor's cache
FEW = 8
CELLS = 1 << 17
#: nodes of the trees that a scoring task holds (14 bytes each)
HELD_NODES = 8_000_000
#: rows of a scored block
BLOCK = 4096
#: (row, feature, bin) cells that permuted scores are kept in at a time (8 bytes each)
CHANGED_CELLS = 1 << 21
MAX_DEPTH = 30
_PART = "tree int, node long, size int, feature binary, cut binary, below binary, value binary, gains array<double>"


# ---------------------------------------------------------------- arrays inside tasks
def _blobs(column) -> list:
    """The binary values of a column, without a copy."""
    return [b.as_buffer() if b.is_valid else b"" for chunk in (column.chunks if hasattr(column, "chunks") else [column])
            for b in chunk]


def _matrix(arrays, p: int) -> np.ndarray:
    """Rows of p doubles from a list column; missing entries are NaN."""
    flat = arrays.flatten()
    return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, p)


def _bin(x: np.ndarray, cuts) -> np.ndarray:
    """Number of cuts below each value; NaN comes after all of them."""
    return np.column_stack([np.searchsorted(np.asarray(c), x[:, j], side="left") for j, c in enumerate(cuts)]
                           ).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


def _mix(a: np.ndarray) -> np.ndarray:
    """Splitmix64: 64 even bits per number."""
    with np.errstate(over="ignore"):
        a = (a + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


#: Poisson(1): chance of at most k; and k by the first 12 bits of an even number, 255 where they don't decide
_CHANCES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_BY_BITS = np.searchsorted(_CHANCES, np.arange(4097) / 4096, side="right").astype(np.uint8)
_BY_BITS = np.where(_BY_BITS[:-1] == _BY_BITS[1:], _BY_BITS[:-1], 255).astype(np.uint8)


def _draws(ids: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """Number of times each row is in the tree's bag: once, or Poisson(1)."""
    return _drawn(_mix(ids.astype(np.uint64)), tree, seed) if bootstrap else np.ones(len(ids), np.uint8)


def _drawn(mixed: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The draws of the rows whose numbers are ``mixed``."""
    salt = _mix(np.array([(seed << 20) + tree], np.uint64))[0]
    h = _mix(mixed ^ salt)
    out = _BY_BITS[(h >> np.uint64(52)).astype(np.int64)]
    open_ = np.flatnonzero(out == 255)
    u = (h[open_] >> np.uint64(11)).astype("float64") * 2.0 ** -53
    out[open_] = np.searchsorted(_CHANCES, u, side="right")
    return out


def _asked(tree: int, nodes: np.ndarray, p: int, subset: int, seed: int):
    """Features that each node may split on: all, or its own ``subset`` of them."""
    if subset >= p:
        return None
    salt = _mix(np.array([(seed << 20) + tree], np.uint64))[0] ^ np.uint64(0x5851F42D4C957F2D)
    order = _mix(_mix(nodes.astype(np.uint64) ^ salt)[:, None] + np.arange(p, dtype=np.uint64)[None, :])
    return np.argsort(np.argsort(order, axis=1), axis=1) < subset


def _best(wl, sl, weight, total, codes, min_leaf: int, asked):
    """(feature or -1, cut, gain) per node.  ``wl`` and ``sl`` (candidates, features,
    nodes) are weight and sum of the rows up to each candidate cut and are
    overwritten, ``codes`` the candidates' bins."""
    p, nodes = wl.shape[1:]
    wr, sr = weight - wl, total - sl
    bad = np.minimum(wl, wr) < max(min_leaf, 1)
    if asked is not None:
        bad |= ~asked.T
    for w, s in ((wl, sl), (wr, sr)):
        np.maximum(w, 1, out=w)
        s *= s
        s /= w
    score = np.add(sl, sr, out=sl)
    np.putmask(score, bad, -np.inf)
    got = np.maximum.reduce(score, axis=0)
    whole = total * total / np.maximum(weight, 1)
    # equal gains may differ in their last digits: the first one counts
    near = 1e-9 * np.maximum(got - whole, 0) + 1e-13 * np.abs(got)
    near[~np.isfinite(got)] = 0
    far = score < got - near
    cuts = np.minimum.reduce(np.maximum(codes, far.view(np.uint8) * np.uint8(255)), axis=0)
    top, feature, cut = np.full(nodes, -np.inf), np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8)
    for j in range(p):
        better = got[j] > top + near[j]
        top[better], feature[better], cut[better] = got[j, better], j, cuts[j, better]
    gain = top - whole
    feature[~(gain > 1e-12 * np.maximum(top, 1e-300))] = -1
    return feature, cut, gain


def _best_of_bins(w, s, weight, total, min_leaf: int, asked):
    """``_best`` of the weights and sums (bins, features, nodes) of all bins,
    which are overwritten."""
    for b in range(1, len(w)):
        w[b] += w[b - 1]
        s[b] += s[b - 1]
    cuts = np.arange(len(w) - 1, dtype=np.uint8)[:, None, None]
    return _best(w[:-1], s[:-1], weight, total, cuts, min_leaf, asked)


def _search(x, wf, sums, start, size, weight, total, bins: int, min_leaf: int, asked):
    """Best split of every node.  The rows of a node lie together; ``start`` and
    ``size`` say where, nodes of more than ``FEW`` rows come first.  A node of few
    rows is searched over its rows' own bins, the others in groups over all
    bins."""
    p, n = len(x), len(size)
    feature, cut, gain = np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n)

    def found(some, got):
        feature[some], cut[some], gain[some] = got
    mask = lambda some: None if asked is None else asked[some]
    for k in range(2, FEW + 1):
        mine = np.flatnonzero(size == k)
        for i in range(0, len(mine), max(1, CELLS // (k * p))):
            some = mine[i:i + max(1, CELLS // (k * p))]
            at = start[some] + np.arange(k)[:, None]
            xs = np.ascontiguousarray(x[:, at].swapaxes(0, 1))
            wl, sl = np.zeros(xs.shape), np.zeros(xs.shape)
            for q in range(k):
                below = xs[q] <= xs
                wl += below * wf[at[q]]
                sl += below * sums[at[q]]
            found(some, _best(wl, sl, weight[some], total[some], xs, min_leaf, mask(some)))
    big = np.flatnonzero(size > FEW)
    group = np.arange(len(big)) // max(1, CELLS // (bins * p)) + np.cumsum(size[big]) // CELLS
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    for i, e in zip(firsts, [*firsts[1:], len(big)]):
        some, m = big[i:e], e - i
        lo, hi = start[some[0]], start[some[-1]] + size[some[-1]]
        own = np.repeat(np.arange(m), size[some])
        ws, ss, cell = wf[lo:hi], sums[lo:hi], np.empty(hi - lo, np.int64)
        w, s = np.empty((bins, p, m)), np.empty((bins, p, m))
        for j in range(p):
            np.multiply(x[j, lo:hi], m, out=cell, dtype=np.int64)
            if m > 1:
                cell += own
            w[:, j] = np.bincount(cell, ws, bins * m).reshape(bins, m)
            s[:, j] = np.bincount(cell, ss, bins * m).reshape(bins, m)
        found(some, _best_of_bins(w, s, weight[some], total[some], min_leaf, mask(some)))
    return feature, cut, gain


def _grow(x, y, w, tree: int, root: int, levels: int, bins: int, min_leaf: int, subset: int, seed: int):
    """Arrays (feature or -1, cut, number of the left child, value) of the tree
    below ``root`` in level order, and the gain per feature."""
    p = x.shape[1]
    features, cuts, lefts, values = [], [], [], []
    gains = np.zeros(p)
    heap, wf, first = np.array([root], np.int64), w.astype("float64"), 0
    mean = float((wf * y).sum() / wf.sum())
    sums = wf * (y - mean)
    x = np.ascontiguousarray(x.T)
    laid, size = np.zeros(1, np.int64), np.array([len(y)])  # the nodes in the order in which their rows lie
    for level in range(levels + 1):
        n = len(heap)
        start = np.empty(n, np.int64)
        start[laid] = np.cumsum(size[laid]) - size[laid]
        node = np.repeat(laid, size[laid])
        weight, total = np.bincount(node, wf, n), np.bincount(node, sums, n)
        feature, cut = np.full(n, -1, np.int16), np.zeros(n, np.uint8)
        if level < levels and p:
            feature, cut, gain = _search(x, wf, sums, start, size, weight, total, bins, min_leaf,
                                         _asked(tree, heap, p, subset, seed))
        split = feature >= 0
        rank = np.cumsum(split) - 1
        left = np.where(split, first + n + 2 * rank, 0).astype(np.int32)
        features.append(feature.astype(np.int8))
        cuts.append(cut)
        lefts.append(left)
        values.append(mean + total / weight)
        if not split.any():
            break
        gains += np.bincount(feature[split], gain[split], p)
        heap = np.column_stack([2 * heap[split], 2 * heap[split] + 1]).ravel()
        # a child's rows stay in their order; children of few rows come last
        at = np.flatnonzero(split[node])
        node = node[at]
        right = x[feature[node], at] > cut[node]
        new = 2 * rank[node] + right
        size = np.bincount(new, minlength=len(heap))
        laid = np.argsort(size <= FEW, kind="stable")
        begin = np.empty(len(heap), np.int64)
        begin[laid] = np.cumsum(size[laid]) - size[laid]
        to_right = np.cumsum(right) - right  # rows before this one that go to the right
        own = np.flatnonzero(np.diff(node, prepend=-1))  # where the node's rows begin
        own = np.repeat(own, np.diff(own, append=len(at)))
        to_right -= to_right[own]
        place = begin[new] + np.where(right, to_right, np.arange(len(at)) - own - to_right)
        order = np.empty(len(at), np.int64)
        order[place] = at
        x, wf, sums = np.take(x, order, axis=1), wf[order], sums[order]
        first += n
    return tuple(map(np.concatenate, (features, cuts, lefts, values))) + (gains,)


def _walk(tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to."""
    feature, cut, left = tree[:3]
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[at[live]]
        inner = f >= 0
        live = live[inner]
        if not len(live):
            return at
        a = at[live]
        at[live] = left[a] + (x[live, f[inner]] > cut[a])


def _whole(top, pieces):
    """One tree from its upper nodes and the pieces below them."""
    parts = [tuple(np.array(a, t) for a, t in zip(top[:4], (np.int8, np.uint8, np.int32, np.float64)))]
    at = len(top[0])
    slots = {h: i for i, h in enumerate(top[4])}
    for node, feature, cut, left, value in pieces:
        i = slots[node]
        # always on to the piece's root: no bin is above 255
        parts[0][0][i], parts[0][1][i], parts[0][2][i] = 0, 255, at
        parts.append((feature, cut, left + at, value))
        at += len(feature)
    return tuple(map(np.concatenate, zip(*parts)))


def _packed(tree):
    """A tree for ``_said`` and ``_spread``: one number per node, of its left child, cut, feature
    and whether it is a leaf, and the values.  Whoever is on a leaf stays there."""
    feature, cut, left, value = tree
    leaf = feature < 0
    return (np.where(leaf, np.arange(len(leaf)), left).astype(np.int64) << 24 | np.where(leaf, 255, cut).astype(np.int64) << 16
            | np.where(leaf, 0, feature).astype(np.int64) << 1 | leaf, value)


def _said(tree, x) -> np.ndarray:
    """What the packed tree says of each row; the rows that still walk are few at
    the end, so those on leaves are set aside now and then."""
    packed, value = tree
    out, flat = np.empty(len(x)), x.ravel()
    row, at, turn = np.arange(len(x), dtype=np.int32), np.zeros(len(x), np.int64), 0
    begin = row * np.int32(x.shape[1])
    while len(row):
        turn += 1
        node = packed.take(at)
        code = node.astype(np.int32)
        if turn % 4 == 1:
            leaf = (code & 1).astype(bool)
            if leaf.any():
                out[row[leaf]] = value.take(at[leaf])
                row, begin, node, code = row[~leaf], begin[~leaf], node[~leaf], code[~leaf]
        cell = code >> 1
        cell &= 32767
        cell += begin
        code >>= 16
        code &= 255
        at = node >> 24
        at += flat.take(cell) > code
    return out


def _wanted(x, shifted, bins: int):
    """(rows, features, bins + 1): how many of the bins below b are met when the
    row's value of the feature is replaced by any of ``shifted`` (feature, values)."""
    seen = np.zeros((len(x), x.shape[1], bins), np.uint8)
    for j, v in shifted:
        seen[np.arange(len(x)), j, v] = 1
    out = np.zeros((len(x), x.shape[1], bins + 1), np.uint8)
    np.cumsum(seen, axis=2, out=out[:, :, 1:], dtype=np.uint8)
    return out


def _spread(tree, x, last, wanted, held) -> None:
    """Add to ``held`` (rows, features, bins + 1, as one array) what the tree says of
    each row when one feature has another bin, as steps: its running sum over the
    bins is the prediction at each bin that is ``wanted``.

    A row walks down once.  At each node the other side is taken by a branch on
    which only the node's feature changes, for the bins that lead there; it
    branches again at that feature alone.  Copies that no node tells apart are thus
    never walked one by one.  ``last`` is each feature's last bin."""
    packed, value = tree
    n, p = x.shape
    width = np.int32(wanted.shape[2])
    flat, seen, one = x.ravel(), wanted.ravel(), np.int32(1)
    low, high = np.zeros(n * p, np.int32), np.tile(last.astype(np.int32), n)
    row, at = np.arange(n, dtype=np.int32) * np.int32(p), np.zeros(n, np.int64)
    # branches: cell of the changed feature, first cell of the row, node, first and last bin
    ways = [np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def met(cell, lo, hi):
        return seen.take(cell * width + hi + one) > seen.take(cell * width + lo)
    turn = 0
    while len(row) or len(ways[0]):
        turn += 1
        more = []
        if len(row):
            node = packed.take(at)
            leaf = (node & 1) == 1
            if leaf.any():
                cell = (row[leaf][:, None] + np.arange(p, dtype=np.int32)).ravel()
                v = np.repeat(value[at[leaf]], p)
                held[cell * width + low[cell]] += v
                held[cell * width + high[cell] + one] -= v
                row, node = row[~leaf], node[~leaf]
            code = node.astype(np.int32)
            cut = code >> 16 & 255
            cell = row + (code >> 1 & 32767)
            right = flat.take(cell) > cut
            lo, hi = low.take(cell), high.take(cell)
            above, below = np.maximum(lo, cut + one), np.minimum(hi, cut)
            lo_other, hi_other = np.where(right, lo, above), np.where(right, below, hi)
            low[cell], high[cell] = np.where(right, above, lo), np.where(right, hi, below)
            left = node >> 24
            at = left + right
            k = np.flatnonzero(lo_other <= hi_other)
            k = k[met(cell[k], lo_other[k], hi_other[k])]
            more.append((cell[k], row[k], left[k] + ~right[k], lo_other[k], hi_other[k]))
        if len(ways[0]):
            cell, begin, spot, lo, hi = ways
            node = packed.take(spot)
            code = node.astype(np.int32)
            if turn % 3 == 0:
                done = (code & 1).astype(bool)
                if done.any():
                    k = np.flatnonzero(done)
                    v, c = value.take(spot[k]), cell[k] * width
                    np.add.at(held, c + lo[k], v)
                    np.add.at(held, c + hi[k] + one, -v)
                    k = np.flatnonzero(~done)
                    cell, begin, lo, hi, node, code = (a.take(k) for a in (cell, begin, lo, hi, node, code))
            cut = code >> 16
            cut &= 255
            asked = code >> 1
            asked &= 32767
            asked += begin
            spot = node >> 24
            spot += flat.take(asked) > cut
            # the changed feature itself is asked for; leaves ask for nothing
            k = np.flatnonzero((asked == cell) & ((code & 1) == 0))
            if len(k):
                left, c = node[k] >> 24, cut[k]
                spot[k] = left + (lo[k] > c)
                both = (lo[k] <= c) & (hi[k] > c)
                k, left, c = k[both], left[both], c[both]
                new = met(cell[k], c + one, hi[k])
                more.append((cell[k][new], begin[k][new], left[new] + 1, c[new] + one, hi[k][new]))
                hi[k] = c
            ways = [cell, begin, spot, lo, hi]
        ways = [np.concatenate(a) for a in zip(ways, *more)]


# ---------------------------------------------------------------- fitting
def find_cuts(rows: DataFrame, p: int, max_bins: int) -> list[list[float]]:
    """Cut points of each entry of ``f``: half-way between all values where there
    are at most ``max_bins``, else between the bins that the quantiles of all rows
    bound."""
    long = rows.select(F.posexplode("f").alias("j", "x")).where("x IS NOT NULL AND NOT isnan(x)")
    values = long.distinct()
    few = [r["j"] for r in values.groupBy("j").count().where(F.col("count") <= max_bins).collect()]
    edges: dict[int, list[float]] = {j: [] for j in range(p)}
    for r in values.where(F.col("j").isin(few)).collect():
        edges[r["j"]].append(r["x"])
    at = [k / max_bins for k in range(1, max_bins)]
    for r in long.where(~F.col("j").isin(few)).groupBy("j").agg(F.percentile_approx("x", at, 10000).alias("q")).collect():
        edges[r["j"]] = r["q"]
    edges = {j: sorted(set(v)) for j, v in edges.items()}

    def ends(batches):
        for batch in batches:
            x = _matrix(batch.column(0), p)
            b = _bin(x, [edges[j] for j in range(p)])
            got = []
            for j in range(p):
                known = ~np.isnan(x[:, j])
                order = np.lexsort((x[known, j], b[known, j]))
                bs, xs = b[known, j][order], x[known, j][order]
                starts = np.flatnonzero(np.diff(bs, prepend=-1)) if len(bs) else []
                stops = [*starts[1:], len(bs)] if len(bs) else []
                got += [(j, int(bs[s]), float(xs[s]), float(xs[e - 1])) for s, e in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate(
                (pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["j", "b", "lo", "hi"])
    seen = (rows.select("f").mapInArrow(ends, "j int, b int, lo double, hi double")
            .groupBy("j", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())  # one row per bin
    cuts = []
    for j in range(p):
        mine = sorted((r["b"], r["lo"], r["hi"]) for r in seen if r["j"] == j)
        cuts.append([(a[2] + b[1]) / 2 if a[2] < (a[2] + b[1]) / 2 < b[1] else a[2] for a, b in zip(mine, mine[1:])])
    return cuts


class RandomForest:
    """Settings of a forest; ``fit`` takes rows with ``features`` and the label."""

    def __init__(self, n_trees: int, max_depth: int, min_leaf: int, feature_subset: str, bootstrap: bool, max_bins: int,
                 seed: int, label: str):
        if not 2 <= max_bins <= 255:
            raise ValueError("max_bins must be from 2 to 255")
        self.n_trees, self.max_depth, self.min_leaf = n_trees, min(max_depth, MAX_DEPTH), min_leaf
        self.feature_subset, self.bootstrap, self.max_bins = feature_subset, bootstrap, max_bins
        self.seed, self.label = seed, label

    def _subset(self, p: int) -> int:
        return {"all": p, "auto": p, "sqrt": math.ceil(math.sqrt(p)), "log2": max(1, math.ceil(math.log2(max(p, 1)))),
                "onethird": math.ceil(p / 3)}[self.feature_subset]

    def fit(self, df: DataFrame, piece: int = PIECE) -> ForestModel:
        label = F.col(f"`{self.label}`").cast("double")
        base = df.select(vector_to_array("features").alias("f"), label.alias("y"))
        base = stored(base.withColumn("h", F.xxhash64("f", "y")), "forest-input")
        all_of = base.agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("labels"), F.avg("y").alias("mean"),
                          F.max(F.size("f")).alias("p")).first()
        if not all_of["n"]:
            raise ValueError("a forest needs at least one row")
        if all_of["labels"] < all_of["n"] or not math.isfinite(all_of["mean"]):
            raise ValueError("labels must be numbers")
        n, p, mean = all_of["n"], all_of["p"], all_of["mean"]
        cuts = find_cuts(base, p, self.max_bins)
        numbered = row_number(base, ["h", "y", "f"], "id").select(F.col("id").cast("long"), "f", "y")

        def coded(batches):
            for batch in batches:
                x = _bin(_matrix(batch.column(1), p), cuts)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)), pa.array([r.tobytes() for r in x], pa.binary()),
                                                  batch.column(2)], ["id", "x", "y"])
        rows = stored(numbered.mapInArrow(coded, "id long, x binary, y double"), "forest-rows")
        # the coded rows are few bytes and much work: as many partitions as tasks can run, in the order of the numbers
        rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "id").sortWithinPartitions("id")
        tops, gains = self._upper(rows, n, p, mean, piece)
        parts = self._pieces(rows, p, mean, tops)
        sizes = dict.fromkeys(range(self.n_trees), 1)
        for r in parts.groupBy("tree").agg(F.sum("size").alias("size")).collect():  # one row per tree
            sizes[r["tree"]] = r["size"] + len(tops[r["tree"]][0])
        below = parts.select("tree", F.posexplode("gains").alias("j", "g")).groupBy("tree", "j").agg(F.sum("g").alias("g"))
        for r in below.collect():  # one row per tree and feature
            gains[r["tree"], r["j"]] += r["g"]
        whole = gains.sum(axis=1, keepdims=True)
        share = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(axis=0)
        importances = share / share.sum() if share.sum() > 0 else share
        return ForestModel(parts, tops, cuts, sizes, importances)

    def _upper(self, rows, n: int, p: int, mean: float, piece: int):
        """Nodes above the pieces, per tree as lists (feature, cut, left child,
        value, number): root 1, children 2i and 2i + 1.  A leaf without a value is a
        piece."""
        bins, seed, bootstrap, min_leaf, subset = self.max_bins, self.seed, self.bootstrap, self.min_leaf, self._subset(p)
        tops = {t: ([-1], [0], [0], [math.nan], [1]) for t in range(self.n_trees)}
        gains = np.zeros((self.n_trees, p))
        todo = {t: [0] for t in tops} if n > piece else {}

        def counted(batches):
            sums: dict = {}
            places = {t: np.full(len(tops[t][0]), -1) for t in todo}
            for t, slots in todo.items():
                places[t][slots] = np.arange(len(slots))
            for batch in batches:
                ids, y = batch.column(0).to_numpy(), batch.column(2).to_numpy() - mean
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, p)
                mixed = _mix(ids.astype(np.uint64))
                for t, slots in todo.items():
                    w = _drawn(mixed, t, seed) if bootstrap else np.ones(len(ids), np.uint8)
                    top = [np.array(a, d) for a, d in zip(tops[t][:3], (np.int8, np.uint8, np.int32))]
                    mine = np.flatnonzero(w)
                    place = places[t][_walk(top, x[mine])]
                    mine, at = mine[place >= 0], place[place >= 0] * bins
                    ws = w[mine].astype("float64")
                    got = sums.setdefault(t, np.zeros((len(slots), p, 2, bins)))
                    xs, ys = np.ascontiguousarray(x[mine].T), ws * y[mine]
                    for j in range(p):
                        k = at + xs[j]
                        for i, v in enumerate((ws, ys)):
                            got[:, j, i] += np.bincount(k, v, len(slots) * bins).reshape(-1, bins)
            out = [(t, slots[i], got[i].tobytes()) for t, got in sums.items() for slots in [todo[t]] for i in range(len(slots))]
            for k in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, d) for c, d in zip(zip(*out[k:k + 1000]), (
                    pa.int32(), pa.int32(), pa.binary()))], ["tree", "slot", "h"])

        def chosen(key, table):
            t, slot = (k.as_py() for k in key)
            h = sum(np.frombuffer(b).reshape(p, 2, bins) for b in sorted(map(bytes, _blobs(table.column("h")))))
            asked = _asked(t, np.array([tops[t][4][slot]]), p, subset, seed)
            w, s = h[0].sum(axis=1)
            f, c, g = (a[0].item() for a in _best_of_bins(h[:, 0].T[:, :, None].copy(), h[:, 1].T[:, :, None].copy(),
                                                          np.array([w]), np.array([s]), min_leaf, asked))
            left = h[f, 0, :c + 1].sum() if f >= 0 else 0
            return pa.table({"tree": [t], "slot": [slot], "f": pa.array([f], pa.int32()), "c": pa.array([c], pa.int32()),
                             "g": [float(g)], "value": [mean + s / w], "l": pa.array([int(left)], pa.int64()),
                             "r": pa.array([int(w - left)], pa.int64())}).cast(pa.schema(
                                 [("tree", pa.int32()), ("slot", pa.int32()), ("f", pa.int32()), ("c", pa.int32()),
                                  ("g", pa.float64()), ("value", pa.float64()), ("l", pa.int64()), ("r", pa.int64())]))
        while todo and p:
            got = (rows.mapInArrow(counted, "tree int, slot int, h binary").groupBy("tree", "slot").applyInArrow(
                chosen, "tree int, slot int, f int, c int, g double, value double, l long, r long").collect())
            todo = {}
            for r in sorted(got, key=lambda r: (r["tree"], r["slot"])):  # one row per node of over ``piece`` rows
                feature, cut, left, value, heap = top = tops[r["tree"]]
                i = r["slot"]
                if r["f"] < 0:
                    value[i] = r["value"]
                    continue
                gains[r["tree"], r["f"]] += r["g"]
                feature[i], cut[i], left[i] = r["f"], r["c"], len(feature)
                for k, size in enumerate((r["l"], r["r"])):
                    for a, v in zip(top, (-1, 0, 0, math.nan, 2 * heap[i] + k)):
                        a.append(v)
                    if size > piece:
                        todo.setdefault(r["tree"], []).append(len(feature) - 1)
            todo = {t: [i for i in slots if tops[t][4][i].bit_length() <= self.max_depth] for t, slots in todo.items()}
            todo = {t: slots for t, slots in todo.items() if slots}
        return tops, gains

    def _pieces(self, rows, p: int, mean: float, tops) -> DataFrame:
        """What grows below the upper nodes: one row per piece."""
        bins, seed, bootstrap, min_leaf, subset = self.max_bins, self.seed, self.bootstrap, self.min_leaf, self._subset(p)
        max_depth = self.max_depth
        schema = "tree int, node long, id long, x binary, y binary, w binary"

        def dealt(batches):
            for batch in batches:
                ids, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, p)
                mixed = _mix(ids.astype(np.uint64))
                for t, top in tops.items():
                    w = _drawn(mixed, t, seed) if bootstrap else np.ones(len(ids), np.uint8)
                    drawn = np.flatnonzero(w)
                    at = _walk([np.array(a, d) for a, d in zip(top[:3], (np.int8, np.uint8, np.int32))], x[drawn])
                    at[~np.isnan(np.array(top[3]))[at]] = -1
                    out = []
                    for i in np.unique(at[at >= 0]):
                        mine = drawn[at == i]
                        out.append((t, top[4][i], int(ids[mine[0]]), x[mine].tobytes(), y[mine].tobytes(), w[mine].tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, d) for c, d in zip(zip(*out), (
                            pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                            ["tree", "node", "id", "x", "y", "w"])

        def grown(key, table):
            t, node = (k.as_py() for k in key)
            table = table.sort_by("id")
            x, y, w = (np.frombuffer(b"".join(_blobs(table.column(c))), d) for c, d in (
                ("x", np.uint8), ("y", np.float64), ("w", np.uint8)))
            levels = max_depth - (node.bit_length() - 1)
            feature, cut, left, value, gains = _grow(x.reshape(len(y), p), y, w, t, node, levels, bins, min_leaf, subset, seed)
            return pa.table([pa.array([t], pa.int32()), pa.array([node], pa.int64()), pa.array([len(feature)], pa.int32()),
                             *[pa.array([a.tobytes()], pa.binary()) for a in (feature, cut, left, value)],
                             pa.array([gains.tolist()], pa.list_(pa.float64()))],
                            names=["tree", "node", "size", "feature", "cut", "below", "value", "gains"])
        # pieces are few and costly: as many partitions as tasks can run, never joined by their bytes
        n = max(4 * rows.sparkSession.sparkContext.defaultParallelism, self.n_trees)
        dealt_rows = rows.mapInArrow(dealt, schema).repartition(n, "tree", "node")
        return stored(dealt_rows.groupBy("tree", "node").applyInArrow(grown, _PART), "forest-pieces")


# ---------------------------------------------------------------- scoring
class ForestModel:
    """Pieces in the shared folder, the nodes above them, and the cut points."""

    def __init__(self, parts: DataFrame, tops: dict, cuts: list, sizes: dict, importances):
        self.parts, self.tops, self.cuts, self.sizes = parts, tops, cuts, sizes
        self.featureImportances = DenseVector(importances)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (features) with ``prediction``, the mean of the trees."""
        rows = stored(df.withColumn("_hl_id", F.monotonically_increasing_id()), "forest-scored")
        cuts, p = self.cuts, len(self.cuts)

        def packed(batches):
            for batch in batches:
                x = _bin(_matrix(batch.column(1), p), cuts)
                ids = batch.column(0).to_numpy()
                at = range(0, len(ids), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[i]) for i in at], pa.int64()), pa.array(
                    [x[i:i + BLOCK].tobytes() for i in at], pa.binary()), pa.array([ids[i:i + BLOCK].tobytes() for i in at],
                                                                                 pa.binary())], ["block", "x", "own"])
        blocks = rows.select("_hl_id", vector_to_array("features").alias("f"))
        blocks = stored(blocks.mapInArrow(packed, "block long, x binary, own binary"), "forest-blocks")

        def summed(trees, x):
            return sum(_said(t, x) for t in trees)

        def numbered(own, sums):
            yield pa.table({"_hl_id": np.frombuffer(own, np.int64), "prediction": sums})
        got = self._scored(blocks, F.hash("block"), _packed, summed, numbered, "_hl_id long, prediction double")
        return rows.join(got, "_hl_id").drop("_hl_id")

    def permuted(self, blocks: DataFrame, repeats: int) -> DataFrame:
        """(feature, repeat, label, prediction) of every row of ``hash_blocks`` with
        one feature permuted, as ``importance.permuted`` does it.  A row's copies
        differ in one value, so they are scored together (``_spread``)."""
        cuts, p = self.cuts, len(self.cuts)

        def packed(batches):
            for batch in batches:
                for block, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = _bin(_matrix(rows.values.field("f"), p), cuts)
                    y = rows.values.field("label").to_numpy(zero_copy_only=False).astype("float64")
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([x.tobytes()], pa.binary()),
                                                      pa.array([y.tobytes()], pa.binary())], ["block", "x", "own"])
        coded = stored(blocks.select("block", "rows").mapInArrow(packed, "block long, x binary, own binary"), "forest-blocks")

        last = np.array([len(c) for c in cuts], np.int32)
        bins = int(last.max(initial=0)) + 1
        chunk = max(1, min(BLOCK, CHANGED_CELLS // (p * (bins + 1))))

        def moved(x):
            """(feature, the bins that its rows get) of every turn."""
            size = len(x)
            for turn in range(p * repeats):
                yield turn % p, np.roll(x[:, turn % p], -(1 + (turn * 7919) % (size - 1) if size > 1 else 0))

        def summed(trees, x):
            out = np.empty((p * repeats, len(x)))
            turns = list(moved(x))
            for lo in range(0, len(x), chunk):
                part = slice(lo, lo + chunk)
                mine, values = np.ascontiguousarray(x[part]), [(j, v[part]) for j, v in turns]
                wanted = _wanted(mine, values, bins)
                held = np.zeros(wanted.size)
                for tree in trees:
                    _spread(tree, mine, last, wanted, held)
                held = held.reshape(wanted.shape)
                for b in range(1, bins):
                    held[:, :, b] += held[:, :, b - 1]
                for turn, (j, v) in enumerate(values):
                    out[turn, part] = held[np.arange(len(mine)), j, v]
            return out.ravel()

        def told(own, sums):
            y = np.frombuffer(own)
            sums = sums.reshape(p * repeats, -1)
            for lo in range(0, p * repeats, 15):
                turn = np.repeat(np.arange(lo, min(lo + 15, p * repeats), dtype=np.int32), len(y))
                yield pa.table({"feature": turn % p, "repeat": turn // p, "label": np.tile(y, len(turn) // max(len(y), 1)),
                                "prediction": sums[lo:lo + 15].ravel()})
        return self._scored(coded, F.col("block"), _packed, summed, told, "feature int, repeat int, label double, prediction double")

    def _scored(self, blocks: DataFrame, dealt, held, summed, told, schema: str) -> DataFrame:
        """``told`` of every block (block, x, own) and the trees' mean of ``summed``,
        which adds up the trees, as ``held`` makes them, over the block's rows.  Trees
        are dealt into groups of a bounded number of nodes, blocks into slices by ``dealt``; a task
        takes one of each, trees first.  Where one group holds all trees, it tells the
        mean at once; more groups than that are made only for tables of few blocks."""
        spark, p, tops, n_trees = blocks.sparkSession, len(self.cuts), self.tops, len(self.tops)
        par, n_blocks = spark.sparkContext.defaultParallelism, max(1, blocks.count())
        groups = min(n_trees, max(math.ceil(sum(self.sizes.values()) / HELD_NODES), math.ceil(par / n_blocks)))
        slices = min(n_blocks, max(1, math.ceil(3 * par / groups)))
        of_group = {g: [t for t in sorted(tops) if t % groups == g] for g in range(groups)}
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        none = F.lit(None).cast("binary")
        # a number per pair of group and slice, chosen so that each pair gets a partition of its own
        n = groups * slices
        own_part = {r["p"]: r["id"] for r in spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect()}
        numbers = F.array(*[F.lit(own_part.get(i, i)).cast("long") for i in range(n)])
        trees = self.parts.select((F.col("tree") % groups).alias("g"), every(slices).alias("s"), F.lit(0).alias("kind"),
                                  F.col("tree").cast("long").alias("a"), F.col("node").alias("b"), "feature", "cut", "below",
                                  "value")
        rows = blocks.select(every(groups).alias("g"), F.pmod(dealt, F.lit(slices)).cast("int").alias("s"),
                             F.lit(1).alias("kind"), F.col("block").alias("a"), F.lit(0).cast("long").alias("b"),
                             F.col("x").alias("feature"), (F.col("own") if groups == 1 else none).alias("cut"),
                             none.alias("below"), none.alias("value"))

        def sums_of(batches):
            key, forest, pieces = None, None, {}
            for batch in batches:
                cols = [batch.column(i).to_pylist() for i in range(5)]
                blobs = [_blobs(batch.column(i)) for i in range(5, 9)]
                for g, s, kind, a, b, *four in zip(*cols, *blobs):
                    if (g, s) != key:
                        key, forest, pieces = (g, s), None, {}
                    if kind == 0:
                        pieces.setdefault(a, []).append((b, *[np.frombuffer(bytes(v), d) for v, d in zip(four, (
                            np.int8, np.uint8, np.int32, np.float64))]))
                        continue
                    if forest is None:
                        forest = [held(_whole(tops[t], pieces.pop(t, []))) for t in of_group[g]]
                    yield a, g, bytes(four[1]), summed(forest, np.frombuffer(four[0], np.uint8).reshape(-1, p))

        def partial(batches):
            for a, g, _, sums in sums_of(batches):
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([g], pa.int32()), pa.array(
                    [sums.tobytes()], pa.binary())], ["block", "g", "sums"])

        def whole(batches):
            for _, _, own, sums in sums_of(batches):
                for table in told(own, sums / n_trees):
                    yield from table.to_batches()

        def added(own, got):
            blobs = _blobs(got.sort_by("g").column("sums"))
            return pa.concat_tables(told(bytes(_blobs(own.column("own"))[0]), sum(np.frombuffer(b) for b in blobs) / n_trees))
        met = (trees.unionByName(rows).withColumn("part", F.get(numbers, F.col("g") * slices + F.col("s")))
               .repartition(n, "part").sortWithinPartitions("g", "s", "kind", "a", "b").drop("part"))
        if groups == 1:
            return met.mapInArrow(whole, schema)
        sums = met.mapInArrow(partial, "block long, g int, sums binary")
        return blocks.select("block", "own").groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(added, schema)

    def save(self, path: str) -> None:
        """The pieces, and one row with the rest."""
        import json
        rest = {"tops": self.tops, "cuts": self.cuts, "sizes": self.sizes, "importances": list(self.featureImportances)}
        self.parts.write.mode("overwrite").parquet(f"{path}/pieces")
        spark = self.parts.sparkSession
        spark.createDataFrame([(json.dumps(rest),)], "rest string").coalesce(1).write.mode("overwrite").json(f"{path}/rest")

    @classmethod
    def load(cls, spark, path: str) -> ForestModel:
        import json
        d = json.loads(spark.read.schema("rest string").json(f"{path}/rest").first()["rest"])
        whole = lambda m: {int(k): v for k, v in m.items()}
        return cls(spark.read.schema(_PART).parquet(f"{path}/pieces"), whole(d["tops"]), d["cuts"], whole(d["sizes"]),
                   d["importances"])
