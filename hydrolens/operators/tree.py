"""Regression tree with exact thresholds, grown level by level.

Every level is one set of aggregates: per (node, feature, distinct value) the
count and sum of the label, running sums of both in value order, and from these
the squared error that a cut behind the value takes away.  No bins, no sample:
all midpoints between neighbouring distinct values compete.
``min_samples_split``, ``min_samples_leaf`` and any depth are honoured.

Rows carry their node, named by its path from the root ("" for the root, then L
or R per level).  A level's splits are joined to the rows: by broadcast while
there are at most ``FEW_NODES``, by an ordinary join beyond that.  Every level's
rows are written and read back, so a deep tree has a short lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordered import n_ranges, range_bounds, running_sum

FEW_NODES = 10_000
COLUMNS = ["node", "depth", "n", "value", "feature", "threshold", "gain"]


def _distinct_values(rows: DataFrame, features) -> DataFrame:
    """(node, feature, v, n, sy) per distinct value of a feature in a node."""
    names = F.array(*[F.lit(f) for f in features])
    long = rows.select("node", "y", F.posexplode("x").alias("f", "v")).where("v IS NOT NULL")
    return (long.groupBy("node", F.get(names, F.col("f")).alias("feature"), "v")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy")))


def best_splits(rows: DataFrame, nodes: DataFrame, features, min_leaf: int = 1) -> DataFrame:
    """(node, feature, threshold, gain) of each node's best cut.  Equal gains (to
    six digits) go to the first feature by name and the lowest cut; a missing
    value goes right."""
    by = ["node", "feature"]
    values = stored(_distinct_values(rows, features), "tree-values")
    bounds = range_bounds(values, "v", n_ranges(values))
    sums = running_sum(values, "n", ["v"], "nl", by, bounds=bounds)
    sums = running_sum(sums, "sy", ["v"], "sl", by, bounds=bounds)
    total = nodes.select("node", F.col("n").alias("nt"), F.col("sy").alias("st"))
    c = sums.join(F.broadcast(total) if total.count() <= FEW_NODES else total, "node")
    nr, sr = F.col("nt") - F.col("nl"), F.col("st") - F.col("sl")
    gain = F.col("sl") * F.col("sl") / F.col("nl") + F.try_divide(sr * sr, nr) - F.col("st") * F.col("st") / F.col("nt")
    c = c.where((F.col("nl") >= min_leaf) & (nr >= max(min_leaf, 1))).select(*by, "v", F.round(gain, 6).alias("gain"))
    best = c.where("gain > 0").groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "v")).alias("b"))
    best = best.select("node", "b.feature", "b.v", (-F.col("b.g")).alias("gain"))
    after = values.select("node", "feature", F.col("v").alias("v2")).join(best, by).where("v2 > v")
    after = after.groupBy(*by).agg(F.min("v2").alias("v2"))
    return best.join(after, by, "left").select(
        *by, ((F.col("v") + F.coalesce("v2", "v")) / 2).alias("threshold"), "gain")


def _descend(rows: DataFrame, splits: DataFrame, features, n_splits: int, how: str) -> DataFrame:
    """``rows`` (node, x, ...) in the child nodes of ``splits``."""
    s = splits.select("node", "feature", "threshold")
    j = rows.join(F.broadcast(s) if n_splits <= FEW_NODES else s, "node", how)
    x = F.get("x", F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int") - 1)
    side = F.when(F.coalesce(x <= F.col("threshold"), F.lit(False)), "L").otherwise("R")
    node = F.when(F.col("feature").isNull(), F.col("node")).otherwise(F.concat("node", side))
    return j.withColumn("node", node).drop("feature", "threshold")


def _with_array(df: DataFrame, features) -> DataFrame:
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return df.withColumn("x", F.transform(x, lambda c: F.when(~F.isnan(c), c)))


def grow_tree(df: DataFrame, features, label: str = "label", max_depth: int | None = None,
              min_samples_split: int = 2, min_samples_leaf: int = 1) -> DataFrame:
    """The nodes of the tree: path, depth, rows, mean label and, for inner nodes,
    feature, threshold (values up to it go left) and gain.  Rows without a label
    don't count."""
    features = list(features)
    if not features:
        raise ValueError("a tree needs a feature")
    rows = _with_array(df, features).select(F.lit("").alias("node"), "x", F.col(f"`{label}`").cast("double").alias("y"))
    rows = stored(rows.where("y IS NOT NULL"), "tree-rows")
    found, depth = None, 0
    while True:
        nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"),
                                         F.var_pop("y").alias("var"))
        nodes = stored(nodes, "tree-nodes")
        wide = nodes.where((F.col("n") >= max(min_samples_split, 2)) & (F.col("var") > 0))
        open_nodes = wide.count() if max_depth is None or depth < max_depth else 0
        if open_nodes:
            splits = stored(best_splits(rows.join(wide.select("node"), "node", "left_semi") if depth else rows, wide,
                                        features, min_samples_leaf), "tree-splits")
        else:
            splits = nodes.where("false").select("node", F.lit("").alias("feature"), F.lit(0.0).alias("threshold"),
                                                 F.lit(0.0).alias("gain"))
        level = nodes.join(splits, "node", "left").select(
            "node", F.lit(depth).alias("depth"), "n", (F.col("sy") / F.col("n")).alias("value"), "feature", "threshold", "gain")
        found = level if found is None else found.unionByName(level)
        n_splits = splits.count() if open_nodes else 0
        if not n_splits:
            return found.select(*COLUMNS)
        rows = stored(_descend(rows, splits, features, n_splits, "inner"), "tree-rows")
        depth += 1


def predict_tree(df: DataFrame, nodes: DataFrame, features, out: str = "prediction") -> DataFrame:
    """``df`` with the mean label of each row's leaf."""
    features = list(features)
    nodes = stored(nodes, "tree")
    top = nodes.agg(F.max("depth")).first()[0]
    keep = [c for c in df.columns if c != out]
    rows = _with_array(df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), *[F.col(f"`{f}`") for f in features]),
                       features).select("doc", "x", F.lit("").alias("node"))
    for depth in range(top or 0):
        splits = nodes.where((F.col("depth") == depth) & F.col("feature").isNotNull())
        rows = _descend(rows, splits, features, splits.count(), "left")
    leaves = nodes.select("node", F.col("value").alias("_hl_value"))
    leaves = F.broadcast(leaves) if nodes.count() <= FEW_NODES else leaves
    return rows.join(leaves, "node", "left").select("doc.*", F.col("_hl_value").alias(out))
