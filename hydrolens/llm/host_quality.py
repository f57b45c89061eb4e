"""Quality rules at host level.

Every document is measured and judged by document rules; rule failures are
summed per host (the ``source`` column), each host's failure rate per rule is
shrunk towards the corpus rate with an empirical beta prior (method of moments
over hosts), and a host whose shrunk rate passes ``max_host_rate`` for any rule
is rejected with all its documents.  A document stays if it passes the base
rules itself and its host stands.

DataFrame functions only: words, windows and lines are arrays of the row, so no
text and no word is ever shuffled.

Defined results: a null text has no words and no lines; null ``source`` is one
host of its own; rows that repeat a doc_id are judged one by one; extra columns
are carried untouched by ``quality_filter`` and ignored by the query; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_on_hot_key, packed, stored, table, unpacked

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: a host is rejected when over this shrunk share of its documents fails one rule
MAX_HOST_RATE = 0.75
RULES = ("short", "repeats", "symbols", "dup_lines")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _word(i: Column) -> Column:
    return F.get("_w", i)


def _same_window(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` must hold ``text``; adds the measures, ``base_failed`` and one
    flag per rule.

    Repeated 3-word windows: sort 64-bit window hashes packed with their
    positions (a primitive sort), keep positions whose hash prefix repeats,
    then compare the real words of just those positions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # white space at both ends off, so that the split has no empty ends
    core = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    d = (docs.withColumn("_core", core)
         .withColumn("_w", F.when(F.col("_core") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("_core", f"[{SPACE}]+")))
         .withColumn("_lines", lines)
         .select(*docs.columns, "_w", F.size("_w").alias("_n"),
                 F.length(F.regexp_replace("_core", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
                 F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 F.size("_lines").alias("_n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines")))
    # bits that a position needs
    d = d.withColumn("_bits", F.ceil(F.log2(F.col("_n") + 2)).cast("int"))
    at = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    left = lambda v: F.call_function("shiftleft", v, F.col("_bits"))
    right = lambda v: F.call_function("shiftright", v, F.col("_bits"))
    d = d.withColumn("_h", F.sort_array(F.transform(
        at, lambda i: left(F.xxhash64(_word(i), _word(i + 1), _word(i + 2))).bitwiseOR(i.cast("long")))))
    d = d.withColumn("_p", F.transform(
        F.filter("_h", lambda x, i: _same_window(right(x), right(F.get("_h", i - 1)))
                 | _same_window(right(x), right(F.get("_h", i + 1)))),
        lambda x: (x - left(right(x))).cast("int")))
    d = d.withColumn("_g", F.sort_array(F.transform("_p", lambda p: F.struct(
        F.concat_ws(" ", _word(p), _word(p + 1), _word(p + 2)).alias("g"), p.alias("p")))))
    d = d.withColumn("_r", F.sort_array(F.transform(
        F.filter("_g", lambda x, i: _same_window(x["g"], F.get("_g", i - 1)["g"])
                 | _same_window(x["g"], F.get("_g", i + 1)["g"])), lambda x: x["p"])))
    # words under the windows: a window adds the words that the next one doesn't hold
    d = d.withColumn("n_repeat_words", F.aggregate(
        F.transform("_r", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_r", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x))
    n = F.col("_n").cast("long")
    short = n < MIN_WORDS
    repeats = F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PCT
    return d.select(
        *docs.columns, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (short | repeats).alias("base_failed"), short.alias("fail_short"), repeats.alias("fail_repeats"),
        (F.col("n_symbols") * 10 > n).alias("fail_symbols"),
        (F.col("n_dup_lines") * 10 > F.col("_n_lines") * 3).alias("fail_dup_lines"))


def host_failures(scored: DataFrame) -> DataFrame:
    """Documents and failures of each rule per host (partial sums first)."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"f_{r}") for r in RULES])


def beta_prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) per rule: mean and between-host variance of the rates,
    less what binomial sampling alone explains.  One row reaches the driver."""
    aggs = [F.sum("n").alias("docs"), F.avg(1.0 / F.col("n")).alias("inv")]
    for r in RULES:
        rate = F.col(f"f_{r}") / F.col("n")
        aggs += [F.sum(f"f_{r}").alias(f"s_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    got = hosts.agg(*aggs).first()
    out = {}
    for r in RULES:
        if not got["docs"]:
            out[r] = (1.0, 1.0)
            continue
        m = min(max(got[f"s_{r}"] / got["docs"], 1e-6), 1 - 1e-6)
        between = max(got[f"v_{r}"] - m * (1 - m) * got["inv"], 1e-9)
        weight = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
        out[r] = (m * weight, (1 - m) * weight)
    return out


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``source``, shrunk rate per rule and ``host_rejected``."""
    prior = beta_prior(hosts)
    rates = {r: (F.col(f"f_{r}") + F.lit(a)) / (F.col("n") + F.lit(a + b)) for r, (a, b) in prior.items()}
    return hosts.select("source", "n", *[x.alias(f"rate_{r}") for r, x in rates.items()],
                        F.greatest(*[F.round(x, 9) for x in rates.values()]).alias("_worst")
                        ).withColumn("host_rejected", F.col("_worst") > max_rate).drop("_worst")


def judge(scored: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``scored`` (a stored table) with ``kept``."""
    hosts = stored(host_failures(scored), "hosts")
    total = hosts.agg(F.sum("n")).first()[0] or 0
    verdicts = host_verdicts(hosts, max_rate)
    out = join_on_hot_key(scored, verdicts.select("source", "host_rejected"), "source",
                          hosts.select("source", "n"), total)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def quality_filter(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that stay, all columns as they were."""
    scored = stored(measure(packed(docs, "source", "text")).drop("text"), "measured", "zstd")
    return unpacked(judge(scored, max_rate).where("kept"))


def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scored = stored(measure(docs).drop("text"), "measured")
    return judge(scored).select("doc_id", *MEASURES, "kept")


def op3_sql() -> str:
    """The same for DuckDB, word by word."""
    rate = lambda r: (f"round((f_{r} + a_{r}) / (n + a_{r} + b_{r}), 9)")
    prior = []
    for r in RULES:
        prior.append(f"""least(greatest(sum(f_{r}) / sum(n), 1e-6), 1 - 1e-6) AS m_{r},
 var_pop(f_{r} / n) AS v_{r}""")
    ab = []
    for r in RULES:
        w = f"least(greatest(m_{r} * (1 - m_{r}) / greatest(v_{r} - m_{r} * (1 - m_{r}) * inv, 1e-9) - 1, 1.0), 1e6)"
        ab.append(f"m_{r} * {w} AS a_{r}, (1 - m_{r}) * {w} AS b_{r}")
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS u FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
g AS (SELECT u, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT u, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rp AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT u, count(DISTINCT p) AS n_repeat_words FROM (SELECT u, unnest([i, i+1, i+2]) AS p FROM rp) GROUP BY u),
m AS (SELECT w.u, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rw ON w.u = rw.u),
f AS (SELECT *, n_words < {MIN_WORDS} AS fail_short, 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS fail_repeats,
  n_symbols * 10 > n_words AS fail_symbols, n_dup_lines * 10 > n_lines * 3 AS fail_dup_lines FROM m),
h AS (SELECT source, count(*) AS n, {', '.join(f'CAST(sum(fail_{r}::INT) AS BIGINT) AS f_{r}' for r in RULES)} FROM f GROUP BY source),
p0 AS (SELECT avg(1.0 / n) AS inv, {', '.join(prior)} FROM h),
p AS (SELECT {', '.join(ab)} FROM p0),
v AS (SELECT source, greatest({', '.join(rate(r) for r in RULES)}) > {MAX_HOST_RATE} AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_short OR fail_repeats AS base_failed,
  NOT (fail_short OR fail_repeats) AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
