"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every benchmark item gives its windows of ``WINDOW`` consecutive words (an item
of fewer words is one window).  Windows are byte strings with a blank at both
ends; texts are normalised the same way, so a byte match is a word match.

Per class of window lengths the search keeps, over the last ``B`` bytes of the
current window of the text, a SHIFT table (how far no window can end: those
positions are skipped), and where the shift is zero a bucket of the windows
with that suffix hash, told apart by their first eight bytes and confirmed by
direct comparison.  The text of a batch is cut into lanes that advance together,
each by its own shifts, so the search is one vectorised loop.

The windows are the stated query set.  They are sent to the tasks in blocks of
at most ``BLOCK_BYTES`` of item text; each block is one pass over the texts that
adds to the covered words, so larger sets take more passes, not more memory.

Defined results: a null text (document or item) has no words; items with a null
id are left out; items that share an id share their windows; rows that repeat a
doc_id are judged one by one; extra columns are carried untouched; without
items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, packed, stored, table, unpacked

WINDOW = 13
BLOCK_BYTES = 2 << 20
#: tables reach this far into a window; the rest is compared directly
TABLE_BYTES = 1024
LANE_BYTES = 1024
#: 20 * n_hit >= n_words
MIN_SHARE = 20

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A-Z to lower case; 00-2F, 3A-60 and 7B-7F part words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
              for c in range(256))


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_FOLD)


class _Class:
    """SHIFT table and suffix buckets of windows of similar length."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        self.patterns, self.ids = patterns, np.array(ids)
        self.m = m = min(TABLE_BYTES, min(map(len, patterns)))
        # long enough blocks that random text seldom meets one
        self.b = min(m, 16, max(2, int(np.ceil(np.log2(2 * m * len(patterns)) / 2))))
        self.bits = int(min(22, max(12, np.ceil(np.log2(8 * m * len(patterns))))))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << self.bits, m - self.b + 1, np.int32)
        flat = np.concatenate([np.zeros(16, np.uint8), heads.ravel(), np.zeros(8, np.uint8)])
        words = loads(flat)
        first = 16 + np.arange(len(patterns)) * m
        for end in range(self.b, m + 1):
            np.minimum.at(self.shift, self.hash(words, first + end), m - end)
        tail = self.hash(words, first + m)
        order = np.argsort(tail, kind="stable")
        self.order, self.tails = order, tail[order]
        self.heads = words[first[order]] if m >= 8 else np.zeros(len(order), np.uint64)

    def hash(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the ``b`` bytes before ``end``."""
        b = self.b
        if b <= 8:
            h = (words[end - 8] >> np.uint64(8 * (8 - b))) * _K1
        else:
            h = words[end - 8] * _K1 ^ (words[end - 16] >> np.uint64(8 * (16 - b))) * _K2
        return (h ^ (h >> np.uint64(29))) * _K1 >> np.uint64(64 - self.bits)

    def find(self, buf: bytes, words: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(start, window id) of every occurrence in ``buf[16:16 + n]``."""
        m = self.m
        if n < m:
            return
        # window ends, exclusive; a lane owns the windows that start in it
        pos = np.arange(16, 16 + n, LANE_BYTES) + m
        stop = np.minimum(pos + LANE_BYTES, 16 + n + 1)
        found = []
        open_ = pos < stop
        pos, stop = pos[open_], stop[open_]
        while len(pos):
            s = self.shift[self.hash(words, pos)]
            hit = s == 0
            if hit.any():
                found.append(pos[hit])
            pos = pos + np.maximum(s, 1)
            open_ = pos < stop
            if not open_.all():
                pos, stop = pos[open_], stop[open_]
        if not found:
            return
        ends = np.concatenate(found)
        h = self.hash(words, ends)
        lo, hi = np.searchsorted(self.tails, h), np.searchsorted(self.tails, h, "right")
        count = hi - lo
        where = np.repeat(np.arange(len(ends)), count)
        which = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count) + lo[where]
        starts = ends[where] - m
        if m >= 8:
            same = words[starts] == self.heads[which]
            starts, which = starts[same], which[same]
        for s, k in zip(starts.tolist(), self.order[which].tolist()):
            p = self.patterns[k]
            if buf[s:s + len(p)] == p:
                yield s, int(self.ids[k])


def loads(a: np.ndarray) -> np.ndarray:
    """Eight bytes from every offset, as little-endian integers."""
    return np.ndarray((len(a) - 7,), "<u8", a, strides=(1,))


class WindowSet:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            w = fold(text).split()
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                owners[b" " + b" ".join(w[i:i + size]) + b" "].add(item)
        windows = list(owners)
        self.owners = [sorted(owners[w]) for w in windows]
        self.n_words = np.array([w.count(b" ") - 1 for w in windows], np.int64)
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(windows):
            by_size[min(5, len(w).bit_length() - 1)].append(k)
        self.classes = [_Class([windows[k] for k in ks], ks) for ks in by_size.values()]

    def scan(self, texts: list[str | None]):
        """Per text: number of words, covered word runs, items found."""
        raw = b"".join(b" %b \n" % fold(t) for t in texts)
        a = np.frombuffer(raw, np.uint8)
        blank = a == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        if len(keep):
            keep[0] = True
        a = np.concatenate([np.zeros(16, np.uint8), a[keep], np.zeros(8, np.uint8)])
        n = len(a) - 24
        buf, words = a.tobytes(), loads(a)
        ends = np.flatnonzero(a[16:16 + n] == 10) + 16
        at = np.flatnonzero(a[:16 + n] == 32)
        at = at[a[at + 1] != 10]  # the blank before each word
        doc_first = np.searchsorted(at, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0, int)
        n_words = np.diff(np.append(doc_first, len(at)))
        items: dict[int, set[str]] = defaultdict(set)
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for c in self.classes:
            for s, k in c.find(buf, words, n):
                w = int(np.searchsorted(at, s))
                d = int(np.searchsorted(doc_first, w, "right")) - 1
                items[d].update(self.owners[k])
                runs[d].append((w - int(doc_first[d]), w - int(doc_first[d]) + int(self.n_words[k])))
        return n_words, runs, items


def merge_runs(runs) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_FOUND = pa.list_(pa.list_(pa.int64()))


def _pass(windows):
    """Adds one block's findings to n_words, runs and items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            n_words, runs, items = windows.value.scan(b.column(names.index("text")).to_pylist())
            had, items_had = (b.column(names.index(c)).to_pylist() for c in ("runs", "items"))
            new = {"n_words": pa.array(n_words, pa.int64()),
                   "runs": pa.array([merge_runs([*map(tuple, h), *runs.get(i, ())]) for i, h in enumerate(had)], _FOUND),
                   "items": pa.array([sorted({*h, *items.get(i, ())}) for i, h in enumerate(items_had)],
                                     pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(k)) for k, c in enumerate(names)], names=names)
    return run


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (must hold ``text``; no columns ``n_words``, ``runs``,
    ``items``) with n_words, the covered word runs [first, end) and the items
    found, as strings."""
    spark = docs.sparkSession
    arrow_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast("array<array<long>>"),
                            "items": F.array().cast("array<string>")})
    schema = out.schema
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        windows = WindowSet([tuple(r) for r in part.collect()], window)
        if k:
            out = stored(out, "decontaminate-pass", "zstd")
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(windows)), schema)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return (out.withColumn("n_hit", n_hit)
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * MIN_SHARE >= F.col("n_words"))))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    return unpacked(find_items(packed(docs, "text"), benchmark).where("NOT contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op7_sql() -> str:
    """The same for DuckDB."""
    words = lambda t: (f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "  # noqa: E731
                       "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
    return f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bs)),
d AS (SELECT row_number() OVER () AS u, doc_id, {words('text')} AS w FROM documents),
dw AS (SELECT u, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM
       (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT u, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cov AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT u, i, n FROM hit)) GROUP BY u),
its AS (SELECT u, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT u, item FROM hit) GROUP BY u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {MIN_SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov ON d.u = cov.u LEFT JOIN its ON d.u = its.u"""
