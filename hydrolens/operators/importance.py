"""Permutation importance without moving copies of the rows.

The rows are dealt once into blocks of ``BLOCK`` rows by a hash order of their
key, so a block is a random part of the table.  Inside a block every (feature,
repeat) takes the feature's values from another row, a fixed number of places
on, which permutes them; a block's rows are one array, read in place.  The copies
that a model must score exist only as they stream through one stage: nothing
but the rows themselves is shuffled, however many features and repeats there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import regression_metrics, split_hash
from .ordered import row_number

BLOCK = 4096


def hash_blocks(df: DataFrame, key: str, label: str, features, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(block, rows): the rows of each block as an array of (pos, label, f) in
    hash order.  Blocks hold ``block`` rows, the last one what is left; equal
    hashes are told apart by the key, rows that repeat a key by their values."""
    number = F.coalesce(F.conv(F.substring(split_hash(key, seed), 1, 13), 16, 10).cast("long"), F.lit(-1))
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    rows = df.select(number.alias("h"), F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("double").alias("label"),
                     x.alias("f"))
    at = row_number(rows, ["h", "k", "label", "f"], "n").withColumn("n", F.col("n") - 1)
    row = F.struct((F.col("n") % block).cast("int").alias("pos"), "label", "f")
    return (at.groupBy(F.floor(F.col("n") / block).alias("block"))
            .agg(F.sort_array(F.collect_list(row)).alias("rows")))  # at most ``block`` rows


def permuted(blocks: DataFrame, n_features: int, repeats: int) -> DataFrame:
    """(feature, repeat, label, f) for every row, feature and repeat, ``f`` with
    the feature's value of another row of the block.  The shift differs by
    feature and repeat; a block of one row has nothing to change with."""
    size = F.size("rows")
    turn = F.col("_hl_turn")
    shift = F.when(size > 1, 1 + (turn * 7919) % (size - 1)).otherwise(0).cast("int")
    feature = (turn % n_features).cast("int")

    def row(x, i):
        other = F.get("rows", ((i + F.col("_hl_shift")) % size).cast("int"))["f"]
        return F.struct(x["label"].alias("label"), F.transform(
            x["f"], lambda v, j: F.when(j == F.col("feature"), F.get(other, j)).otherwise(v)).alias("f"))
    turns = blocks.withColumn("_hl_turn", F.explode(F.sequence(F.lit(0), F.lit(n_features * repeats - 1))))
    turns = turns.select("rows", feature.alias("feature"), F.floor(turn / n_features).cast("int").alias("repeat"),
                         shift.alias("_hl_shift"))
    return (turns.select("feature", "repeat", F.explode_outer(F.transform("rows", row)).alias("r"))
            .select("feature", "repeat", "r.label", "r.f"))


def permutation_importance(df: DataFrame, key: str, label: str, features, predict: Callable[[DataFrame], DataFrame],
                           repeats: int = 10, seed: int = 42,
                           predict_permuted: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(feature, importance_mean, importance_std): mean and population deviation
    of the drop in R² when one feature is permuted, over ``repeats`` permutations.

    ``predict`` takes a frame with ``f`` (array of the features' values) and adds
    ``prediction`` without a shuffle.  A model that can't, because it is too large
    for one task, gives ``predict_permuted``: from ``hash_blocks`` and repeats to
    ``permuted`` with ``prediction``."""
    features = list(features)
    blocks = hash_blocks(df, key, label, features, seed)
    if not features or not repeats:
        return df.sparkSession.createDataFrame([], "feature string, importance_mean double, importance_std double")
    plain = blocks.select(F.explode_outer("rows").alias("r")).select("r.label", "r.f")
    base = regression_metrics(predict(plain), "label", "prediction").first()
    scored = predict_permuted(blocks, repeats) if predict_permuted else predict(permuted(blocks, len(features), repeats))
    r2 = regression_metrics(scored, "label", "prediction", ["feature", "repeat"])
    drop = F.lit(base["r2"] if base else None).cast("double") - F.col("r2")
    names = F.array(*[F.lit(f) for f in features])
    return (r2.groupBy("feature").agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))
            .select(F.get(names, F.col("feature")).alias("feature"), "importance_mean", "importance_std"))
