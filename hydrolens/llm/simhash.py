"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints: 64-bit majority of the XXH64 hashes (seed 42) of the 3-word
shingles of the lower-cased text, repeats included.

Links (at most ``MAX_BITS`` differing bits): equal fingerprints are one node,
so copies never meet.  Two nodes within ``MAX_BITS`` bits agree on at least one
of ``MAX_BITS + 1`` blocks of bits; nodes that agree on a block fall into the
same bucket.  A bucket is stored as 64 bit planes (one machine word holds one
bit of 64 nodes); a tile of queries runs down the planes, adding the differing
bits of all pairs into carry-save counters (ones, twos, ...), and leaves as soon
as every pair of the tile has exceeded the radius.  A bucket keeps only a
spanning forest of its links.  A bucket over ``BUCKET_NODES`` is dealt out as
pairs of chunks, so no task holds more than two chunks of it.

Groups: connected components of the links by alternating hook-to-smallest
steps, each step a checkpointed table.

Defined results: a null text has no words; a text without words has the
fingerprint zero and is linked like any other; a null doc_id belongs to its
group but never names it (a group of only null doc_ids has a null
component_id); rows that repeat a doc_id each get their row; extra columns are
carried untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, join_on_hot_key, packed, stored, table, unpacked

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BUCKET_NODES = 4096
TILE = 256


# -- fingerprints -----------------------------------------------------------------------------
def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprint of every text."""
    from xxhash import xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if not text:
            continue
        words = text.encode("utf-8", "replace").lower().split()
        n = len(words)
        if not n:
            continue
        if n <= shingle:
            hashes.append(xxh64_intdigest(b" ".join(words), SEED))
            counts[k] = 1
            continue
        grams = words
        for j in range(1, shingle):
            grams = [b"%b %b" % p for p in zip(grams, words[j:])]
        hashes += [xxh64_intdigest(g, SEED) for g in grams]
        counts[k] = len(grams)
    out = np.zeros(len(texts), np.uint64)
    h = np.array(hashes, np.uint64)
    ends = np.cumsum(counts)
    # a bounded number of hashes unpacked at a time; a long text spans several rounds
    ones = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    for a in range(0, len(h), 1 << 17):
        part, who = h[a:a + (1 << 17)], owner[a:a + (1 << 17)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    assert len(ends) == 0 or ends[-1] == len(h)
    set_ = 2 * ones > counts[:, None]
    for bit in range(64):
        out |= set_[:, bit].astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def _fingerprint_task(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.names.index("text")
            keep = [i for i in range(b.num_columns) if i != k]
            fp = pa.array(fingerprints(b.column(k).to_pylist(), shingle), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), fp],
                                             names=[*(b.schema.names[i] for i in keep), "fp"])
    return run


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (must hold ``text``) without the text, with ``fp``."""
    from pyspark.sql.types import LongType, StructType
    schema = StructType([f for f in docs.schema.fields if f.name != "text"]).add("fp", LongType())
    return docs.mapInArrow(_fingerprint_task(shingle), schema)


# -- links ------------------------------------------------------------------------------------
def block_ranges(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of max_bits + 1 blocks that cover 64 bits."""
    n = max_bits + 1
    cut = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """planes[b, w]: bit b of the nodes 64 w ... 64 w + 63."""
    pad = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    pad[:len(fps)] = fps
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_pairs(queries: np.ndarray, nodes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, node) with at most ``max_bits`` differing bits."""
    n_counters = max_bits.bit_length()
    planes = bit_planes(nodes)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    lanes = np.full(planes.shape[1], full)
    if len(nodes) % 64:
        lanes[-1] = np.uint64((1 << (len(nodes) % 64)) - 1)
    found_q, found_n = [], []
    for a in range(0, len(queries), TILE):
        q = queries[a:a + TILE]
        shape = (len(q), planes.shape[1])
        counters = [np.zeros(shape, np.uint64) for _ in range(n_counters)]
        over = np.broadcast_to(~lanes, shape).copy()
        gone = False
        for bit in range(64):
            flip = np.where((q >> np.uint64(bit)) & np.uint64(1), full, np.uint64(0))
            carry = planes[bit][None, :] ^ flip[:, None]
            for c in counters:  # carry-save add of one bit per lane
                carry, c[...] = c & carry, c ^ carry
            over |= carry
            if max_bits + 1 < 1 << n_counters:  # counts above the radius that still fit the counters
                more = over.copy()
                for value in range(max_bits + 1, 1 << n_counters):
                    is_value = np.full(shape, full)
                    for k, c in enumerate(counters):
                        is_value &= c if value >> k & 1 else ~c
                    more |= is_value
                over = more
            if bit >= 2 * max_bits and bit % 4 == 3 and bool((over == full).all()):
                gone = True
                break
        if gone:
            continue
        rows, words = np.nonzero(over != full)
        left = ~over[rows, words]
        bits = np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(bits)
        found_q.append(rows[i] + a)
        found_n.append(words[i] * 64 + lane)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_n)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked with each index by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _bucket_task(max_bits: int):
    def run(t: pa.Table) -> pa.Table:
        fps = np.unique(t.column("fp").to_numpy().view(np.uint64))
        q, k = near_pairs(fps, fps, max_bits)
        root = forest(len(fps), q, k)
        i = np.flatnonzero(root != np.arange(len(fps)))
        s = fps.view(np.int64)
        return pa.table({"a": pa.array(s[i]), "b": pa.array(s[root[i]])})
    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """``nodes`` (distinct ``fp``) -> spanning links (a, b) of every bucket."""
    n = nodes.count()
    buckets = max(1, -(-n // bucket_nodes) * 2)
    ranges = block_ranges(max_bits)
    keys = F.array(*[F.struct(F.lit(k).alias("block"), F.pmod(F.xxhash64(
        F.lit(k), F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))),
        F.lit(buckets)).cast("int").alias("part")) for k, (first, width) in enumerate(ranges)])
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.part")
    # chunks of the buckets that are too full: every pair of chunks is a task of its own
    full = (rows.groupBy("block", "part").count().where(F.col("count") > 2 * bucket_nodes)
            .select("block", "part", F.ceil(F.col("count") / bucket_nodes).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    dealt = (rows.join(full, ["block", "part"], "left")
             .withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", chunk)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("fp", "block", "part", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2")))
    return dealt.groupBy("block", "part", "c1", "c2").applyInArrow(_bucket_task(max_bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (fp, root): the smallest node that each linked node
    reaches.  Large-star and small-star steps until nothing changes."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "links")
    last = None
    while True:
        # large star: every larger neighbour hooks to the smallest neighbour
        both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself hook to the smallest neighbour
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        e2 = (e1.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
              .union(low.select("a", F.col("m").alias("b"))).distinct())
        e = stored(e2, "links")
        # stable when every node has one link and no root hangs on another node
        got = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == last:
            return e.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        last = tuple(got)


def group_documents(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    bucket_nodes: int = BUCKET_NODES) -> DataFrame:
    """``docs`` (doc_id, text and more) -> the same without the text, with
    ``fp`` and ``component_id``."""
    arrow_batches(docs.sparkSession)
    rows = stored(with_fingerprint(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    comp = components(links(nodes.select("fp"), max_bits, bucket_nodes))
    rooted = (nodes.join(comp, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return join_on_hot_key(rows, stored(named.select("fp", "component_id"), "groups"), "fp",
                           nodes.select("fp", "n"), total)


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The document that names its group, one row of it; all columns as they
    were.  Groups without any doc_id keep one row of their smallest text."""
    d = packed(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc"))
    groups = stored(group_documents(d.select("doc_id", "text", "row"), shingle, max_bits), "grouped")
    # (doc_id, row) names a row up to full equality
    keep = (groups.where("doc_id = component_id OR component_id IS NULL")
            .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own"))
            .agg(F.min(F.struct("doc_id", "row")).alias("k")).select("k.doc_id", "k.row"))
    k = keep.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))
    staying = d.join(k, same, "left_semi")
    once = Window.partitionBy("doc_id", "row").orderBy("row")
    return unpacked(staying.withColumn("_n", F.row_number().over(once)).where("_n = 1"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_documents(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                        "component_id")
