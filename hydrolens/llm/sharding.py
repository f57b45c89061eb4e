"""Uniform shuffle into shards of exact sizes by a hypergeometric
communication matrix.

The rows lie in many even source parts (by a hash of the row).  How many rows
of each part go to each shard is drawn first: the exact matrix of a uniform
random permutation, whose rows sum to the parts' sizes and whose columns sum to
the shards' sizes.  Each part is then permuted by itself and cut into runs of
the drawn lengths, the runs are exchanged, and each shard is permuted again.

A shard may be huge, so its permutation is spread over many tasks: rows go to
even segments of a random key, and a slot is the rows of all segments before
plus the place within the segment.  Only the counts per part reach the driver.
There are sqrt(rows) / 4 parts, so the matrix and the parts grow alike: at 1e11
rows 80,000 parts of 1.3 million rows.

DataFrame functions only; the matrix itself is drawn on the driver from the
parts' counts.  Keys are hashes of (seed, whole row, number of the row), so that
equal rows are shuffled apart; they are written to a table before they are used,
so a lost executor repeats the same draw.

Law ``rows``: shard sizes differ by at most one row.  Defined results: a null
text has size 1 and the checksum of the empty text; a null doc_id is dealt like
any other; equal rows have independent shards and slots; extra columns are carried untouched
by ``shard_documents``; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, stored, table

N_SHARDS = 16
SEED = 17


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement: inversion that
    walks outwards from the mode, exact for any size."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    if u < 0:
        return mode
    up, down, p_up, p_down = mode, mode, p, p
    while up < hi or down > lo:
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode  # rounding left a sliver


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``parts``, columns to ``shards``; distributed as in a
    uniform random permutation."""
    rng, left = random.Random(seed), list(shards)
    out = []
    for size in parts:
        row, need, rest = [], size, sum(left)
        for have in left:
            take = hypergeometric(rng, have, rest - have, need)
            row.append(take)
            need -= take
            rest -= have
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def assign(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (columns ``_key``, ``_part``,
    ``_again`` must be free)."""
    spark = rows.sparkSession
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    key = F.xxhash64(F.lit(seed), whole, F.monotonically_increasing_id())
    keyed = stored(rows.select("*", key.alias("_key")), "sharding", "zstd")
    n = keyed.count()
    n_parts = max(1, math.isqrt(n) // 4)
    part = F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(n_parts)).cast("int")
    sizes = {r["p"]: r["n"] for r in keyed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(n_parts)], shard_sizes(n, n_shards), seed)
    # shard s takes the places [_lo, _hi) of the part's permutation
    drawn = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(matrix)), "array<array<bigint>>"))
                                  .alias("_p", "_row"))
    runs = (drawn.select("_p", F.posexplode("_row").alias("shard", "_take"),
                         F.transform("_row", lambda x, i: F.aggregate(F.slice("_row", 1, i), F.lit(0).cast("long"),
                                                                      lambda a, b: a + b)).alias("_before"))
            .select("_p", "shard", F.get("_before", "shard").alias("_lo"),
                    (F.get("_before", "shard") + F.col("_take")).alias("_hi")))
    place = Window.partitionBy("_part").orderBy(F.xxhash64("_key", F.lit(2)), "_key")
    local = (keyed.withColumn("_part", part)
             .withColumn("_place", F.row_number().over(place).cast("long") - 1))
    dealt = local.join(runs, (F.col("_part") == F.col("_p")) & (F.col("_place") >= F.col("_lo"))
                       & (F.col("_place") < F.col("_hi"))).drop("_p", "_lo", "_hi", "_place", "_part")
    # second permutation: even segments of a fresh key
    n_segments = max(1, n_parts // n_shards)
    fresh = F.shiftrightunsigned(F.xxhash64("_key", F.lit(3)), 2)
    width = (1 << 62) // n_segments + 1
    dealt = stored(dealt.withColumn("_again", fresh)
                   .withColumn("_seg", F.expr(f"_again DIV {width}").cast("int")), "dealt", "zstd")
    before = Window.partitionBy("shard").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    base = (dealt.groupBy("shard", "_seg").agg(F.count(F.lit(1)).alias("_n"))
            .select(F.col("shard").alias("_s"), F.col("_seg").alias("_g"),
                    F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy("shard", "_seg").orderBy("_again", "_key")
    return (dealt.withColumn("_place", F.row_number().over(inside).cast("long") - 1)
            .join(base, (F.col("shard") == F.col("_s")) & (F.col("_seg") == F.col("_g")))
            .withColumn("slot", F.col("_base") + F.col("_place"))
            .select(*rows.columns, "shard", "slot"))


def _text_columns():
    text = F.coalesce(F.col("text"), F.lit(""))
    return (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *_text_columns())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; law ``rows``."""
    out = assign(digest(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """``doc`` (all columns of the row), size, text_crc32, law, shard, slot:
    the whole documents in their shards."""
    rows = packed(docs, "doc_id", "text").select("doc", "doc_id", *_text_columns())
    return assign(rows, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "doc")
