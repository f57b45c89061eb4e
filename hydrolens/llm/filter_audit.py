"""How filters interact: what every order of five filters keeps and loses.

A document's failures are a mask of five bits.  Every mask has one big integer
whose 64-bit fields hold what happens to a document of that mask in each of the
600 (order, step) places: still kept after the step, removed by it, redundant
(fails the filter but is gone already), and failing that filter alone.  The
integers of all documents of a part are summed (a mask that comes n times adds n
times its integer; no field can pass the part's row count, so none runs over
into the next), and the sums of all documents, of the good ones and of the toxic
ones are taken apart into the counts.

Filters (failure conditions) on whole texts, words being maximal runs outside
``[\\x20\\x09-\\x0D]``: A under 50 words; B 100 * distinct words < 65 * words;
C 100 * capital letters A-Z > 5 * code points; D holds any of ``#$%&*|``;
E equal to the text of any smaller doc_id.

Texts are read once and never shuffled: a row goes on as id, part, mask and
SHA-256 of its text.  The least id per repeated text and the labels are joined
to those rows; texts repeated over a large share of the table are joined by
broadcast of at most 200 rows.  (part, mask, labels) rows are counted before the
integers are summed, so a part sums at most 128 of them.

Defined results: a null text is an empty one (no words: A fails, B and C do
not); a null part is the empty string and shares its row; a null doc_id is
smaller or larger than none, so it neither fails E nor makes another fail, and
has no label; rows that repeat a doc_id are counted one by one and are no
smaller than each other; a doc_id with several label rows is good (toxic) if any
of them says so; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, join_on_hot_key, stored, table

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_CAPITALS_PCT = 5
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
COUNTS = [*OUTCOMES[:3], "unique_fails", "good_lost", "toxic_lost", "shapley"]
FIELD_BYTES = 8


def text_mask(raw: bytes, n_points: int) -> int:
    """Bits of the filters A to D that the text fails."""
    words = raw.split()  # ASCII white space: 0x20, 0x09 to 0x0D
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PCT * n) << 1
            | (100 * capitals > MAX_CAPITALS_PCT * n_points) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, hashes = [], []
        for text in b.column("text"):
            s = text.as_py() or ""
            raw = s.encode("utf-8", "surrogatepass")
            masks.append(text_mask(raw, len(s)))
            hashes.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(hashes, pa.binary())],
            names=["doc_id", "part", "mask", "h"])


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): one row per document of ``docs`` (doc_id, text, part)."""
    arrow_batches(docs.sparkSession)
    rows = stored(docs.select("doc_id", "text", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
                  .mapInArrow(_masks, "doc_id long, part string, mask int, h binary"), "masks")
    texts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    texts = stored(texts.where("n > 1"), "repeats")  # a text met once has no copy
    out = join_on_hot_key(rows, texts.select("h", "first"), "h", texts.select("h", "n"), rows.count())
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return out.select("doc_id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (0 or 1)."""
    per_id = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
              .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                   F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
              .where("good = 1 OR toxic = 1"))
    known = rows.where("doc_id IS NOT NULL").join(per_id, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    nameless = rows.where("doc_id IS NULL").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(nameless).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})


@cache
def mask_integers() -> list[int]:
    """The big integer of every mask: 600 places of len(OUTCOMES) fields."""
    found = []
    for mask in range(1 << len(FILTERS)):
        fields = np.zeros((len(ORDERS), len(FILTERS), len(OUTCOMES)), "<u8")
        for o, order in enumerate(ORDERS):
            here = True
            for s, letter in enumerate(order):
                bit = 1 << FILTERS.index(letter)
                fails = bool(mask & bit)
                removed = here and fails
                here = here and not fails
                fields[o, s] = here, removed, fails and not removed, mask == bit
        found.append(int.from_bytes(fields.tobytes(), "little"))
    return found


def unpack(total: int) -> np.ndarray:
    """Counts by order, step and outcome."""
    shape = (len(ORDERS), len(FILTERS), len(OUTCOMES))
    raw = total.to_bytes(int(np.prod(shape)) * FIELD_BYTES, "little")
    return np.frombuffer(raw, "<u8").reshape(shape).astype("int64")


def _audit_part(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    of = mask_integers()
    total = good = toxic = 0
    for r in rows.to_pylist():
        total += r["n"] * of[r["mask"]]
        good += r["n_good"] * of[r["mask"]]
        toxic += r["n_toxic"] * of[r["mask"]]
    counts, removed_good, removed_toxic = unpack(total), unpack(good)[:, :, 1], unpack(toxic)[:, :, 1]
    place = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    shapley = np.array([counts[:, :, 1][place == f].sum() for f in range(len(FILTERS))])
    n = place.size
    cols = {"part": [key[0].as_py()] * n, "filter_order": np.repeat(ORDERS, len(FILTERS)),
            "step": np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)).astype("int32")}
    cols |= {c: counts[:, :, i].ravel() for i, c in enumerate(OUTCOMES)}
    cols |= {"good_lost": removed_good.ravel(), "toxic_lost": removed_toxic.ravel(), "shapley": shapley[place].ravel()}
    return pa.table({c: pa.array(v) for c, v in cols.items()})


def audit(rows: DataFrame) -> DataFrame:
    """600 rows per part from ``rows`` (part, mask, good, toxic)."""
    counts = (rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("n_good"),
                                               F.sum("toxic").alias("n_toxic")))
    longs = ", ".join(f"{c} long" for c in COUNTS)
    return counts.groupBy("part").applyInArrow(_audit_part, f"part string, filter_order string, step int, {longs}")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of the five filters does to each source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("part"))
    return audit(with_labels(masked(docs), table(spark, sf_dir, "labels")))


def op12_sql() -> str:
    """The same for DuckDB, document by order by step."""
    return f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
firsts AS (SELECT t AS t1, min(doc_id) AS first FROM w GROUP BY t),
lab AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
  max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, [len(ws) < {MIN_WORDS}, 100 * len(list_distinct(ws)) < {MIN_DISTINCT_PCT} * len(ws),
  100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MAX_CAPITALS_PCT} * length(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(doc_id > first, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w JOIN firsts ON t = t1 LEFT JOIN lab ON doc_id = id),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
l AS (SELECT chr(CAST(64 + i AS INTEGER)) AS x FROM range(1, 6) r(i)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
st AS (SELECT filter_order, CAST(s AS INTEGER) AS step, ascii(filter_order[s]) - 64 AS k,
  [ascii(filter_order[j]) - 64 FOR j IN range(1, s)] AS before FROM o, range(1, 6) r(s)),
e AS (SELECT part, filter_order, step, k, n, good, toxic, f[k] AS fails, list_sum([f[j]::INT FOR j IN f_all]) AS n_fails,
  len([j FOR j IN before IF f[j]]) > 0 AS gone FROM (SELECT *, range(1, 6) AS f_all FROM c, st)),
g AS (SELECT part, filter_order, step, any_value(k) AS k, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM e GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM g"""
