"""URL filters: temporal join of captures with dated block lists.

List entries are events: on a day, a list adds or removes a pattern.  Events
become validity intervals [added, next event), and every capture is evaluated
against the patterns that are active on its fetch day.

A pattern is a host (matches it and all hosts below it) or a host with leading
path segments.  A URL is evaluated by its canonical site, host and path, so its
candidate patterns are the host's suffixes and the path's leading parts.

DataFrame functions only.  The interval join runs over distinct (pattern, day)
pairs and calendar months, so a hot host is as many rows as it has days, and a
pair meets at most one month of a pattern's intervals.  The way back to sites
and captures splits hot keys.

Defined results: a URL that is null or has no host, or a null day, is on no
list; events without list, pattern, day or a known action are left out; an
addition wins over a removal of the same day; rows that repeat a page_id are
evaluated one by one; extra columns are carried untouched by ``evaluate``;
empty tables give empty results or captures on no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_on_hot_key, packed, stored, table

_URL = r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a closing dot; null where there is none."""
    h = F.regexp_replace(F.lower(F.regexp_extract(url, "(?i)" + _URL, 1)), r"\.+$", "")
    return F.when(h != "", h)


def path(url: Column) -> Column:
    """Path segments, empty ones left out."""
    return F.filter(F.split(F.regexp_extract(url, "(?i)" + _URL, 2), "/"), lambda x: x != "")


def candidates(host_: Column, path_: Column) -> Column:
    """All patterns that match a site."""
    labels = F.split(host_, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    parts = F.transform(path_, lambda _, i: F.concat(host_, F.lit("/"), F.array_join(F.slice(path_, 1, i + 1), "/")))
    return F.array_distinct(F.concat(suffixes, parts))


def intervals(events: DataFrame) -> DataFrame:
    """``events`` (list, pattern, day, action) -> list, pattern, valid_from,
    valid_to (null: still valid).  One state a day, so a pattern's window is as
    long as it has days."""
    days = (events.where("list IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
            .groupBy("list", "pattern", "day").agg(F.max(F.col("action") == "add").alias("added")))
    after = Window.partitionBy("list", "pattern").orderBy("day")
    return (days.withColumn("valid_to", F.lead("day").over(after)).where("added")
            .select("list", "pattern", F.col("day").alias("valid_from"), "valid_to"))


def active_patterns(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """Distinct ``pairs`` (pattern, day) -> those on a list, with the lists."""
    last = pairs.agg(F.max("day").alias("d")).first()["d"]
    if last is None:
        return pairs.select("pattern", "day", F.array().cast("array<string>").alias("lists"))
    month = lambda d: F.trunc(d, "month")
    until = F.coalesce(F.date_sub("valid_to", 1), F.greatest(F.lit(last), F.col("valid_from")))
    spread = valid.withColumn("month", F.explode(F.sequence(
        month(F.col("valid_from")), month(until), F.expr("INTERVAL 1 MONTH"))))
    met = (pairs.withColumn("month", month(F.col("day"))).join(spread, ["pattern", "month"])
           .where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)"))
    return met.groupBy("pattern", "day").agg(F.array_sort(F.collect_set("list")).alias("lists"))


def _pair(pattern: str) -> Column:
    return F.concat_ws(" ", F.col("day").cast("string"), F.col(pattern))


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures`` (url, day and more) as ``doc``, with host, lists, matched
    (the smallest pattern on a list) and blocked."""
    rows = (packed(captures, "url", "day").withColumn("host", host(F.col("url")))
            .withColumn("path", path(F.col("url")))
            .withColumn("site", F.when(F.col("day").isNotNull(), F.concat_ws("/", "host", F.array_join("path", "/"))))
            .withColumn("visit", F.when(F.col("host").isNotNull() & F.col("day").isNotNull(), _pair("site"))))
    visits = stored(rows.where("visit IS NOT NULL").groupBy("visit", "day", "host", "path")
                    .agg(F.count(F.lit(1)).alias("n")), "visits")
    asked = (visits.select("visit", "day", F.explode(candidates(F.col("host"), F.col("path"))).alias("pattern"))
             .withColumn("pair", _pair("pattern")))
    pairs = stored(asked.groupBy("pair", "pattern", "day").agg(F.count(F.lit(1)).alias("n")), "pairs")
    active = active_patterns(pairs.select("pattern", "day"), intervals(events))
    active = stored(active.select(_pair("pattern").alias("pair"), "lists"), "active")
    met = join_on_hot_key(asked, active, "pair", pairs.select("pair", "n"), pairs.agg(F.sum("n")).first()[0] or 0)
    verdicts = stored(met.where("lists IS NOT NULL").groupBy("visit").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))).alias("lists"),
        F.min("pattern").alias("matched")), "verdicts")
    out = join_on_hot_key(rows.drop("path", "site", "url", "day"), verdicts, "visit",
                          visits.select("visit", "n"), visits.agg(F.sum("n")).first()[0] or 0)
    return out.select("doc", "host", F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), "matched",
                      F.col("matched").isNotNull().alias("blocked"))


# -- query ------------------------------------------------------------------------------------
#: ``pages`` has neither fetch times nor lists: days of 2023 and 2024 from the page_id,
#: and one list event from each page's host, parent domain or first path segment
FETCH_DAY = "date_add(DATE'2023-01-01', CAST(page_id % 731 * 7919 % 731 AS INT))"
EVENT_DAY = "date_add(DATE'2023-01-01', CAST(page_id % 731 * 104729 % 731 AS INT))"


def list_events(pages: DataFrame) -> DataFrame:
    h, p = host(F.col("url")), path(F.col("url"))
    pattern = (F.when(F.col("page_id") % 3 == 0, h)
               .when(F.col("page_id") % 3 == 1, F.when(h.contains("."), F.regexp_replace(h, r"^[^.]*\.", "")))
               .otherwise(F.concat(h, F.lit("/"), F.get(p, 0))))
    return pages.select(
        F.concat(F.lit("list"), (F.col("page_id") % 4).cast("string")).alias("list"), pattern.alias("pattern"),
        F.expr(EVENT_DAY).alias("day"), F.when(F.col("page_id") % 5 < 2, "add").otherwise("remove").alias("action"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries that are active on its fetch day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select("page_id", "url", F.expr(FETCH_DAY).alias("day"))
    return evaluate(captures, list_events(pages)).select(
        "doc.page_id", "host", F.col("doc.day").alias("fetch_day"), F.size("lists").cast("long").alias("n_lists"),
        F.array_join("lists", ",").alias("lists"), "matched", "blocked")


def op4_sql() -> str:
    """The same for DuckDB, without the short cuts."""
    u = r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)"
    return f"""WITH p AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{u}', 1)), '\\.+$', ''), '') AS host,
  [x FOR x IN string_split(regexp_extract(url, '{u}', 2), '/') IF x <> ''] AS path,
  CAST(DATE '2023-01-01' + CAST(page_id % 731 * 7919 % 731 AS INTEGER) AS DATE) AS fetch_day,
  CAST(DATE '2023-01-01' + CAST(page_id % 731 * 104729 % 731 AS INTEGER) AS DATE) AS event_day,
  row_number() OVER () AS u FROM pages),
e AS (SELECT 'list' || CAST(page_id % 4 AS VARCHAR) AS list, event_day AS day, page_id % 5 < 2 AS added,
  CASE WHEN page_id % 3 = 0 THEN host
       WHEN page_id % 3 = 1 THEN CASE WHEN contains(host, '.') THEN regexp_replace(host, '^[^.]*\\.', '') END
       ELSE host || '/' || path[1] END AS pattern FROM p),
d AS (SELECT list, pattern, day, bool_or(added) AS added FROM e WHERE pattern IS NOT NULL GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM d),
h AS (SELECT u, fetch_day, unnest(list_distinct(list_concat(
  [array_to_string(string_split(host, '.')[i:], '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
  [host || '/' || array_to_string(path[1:i], '/') FOR i IN range(1, len(path) + 1)]))) AS pattern FROM p WHERE host IS NOT NULL),
m AS (SELECT u, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(DISTINCT list) AS n_lists, min(h.pattern) AS matched
  FROM h JOIN v ON h.pattern = v.pattern AND v.added AND v.day <= fetch_day AND (until IS NULL OR fetch_day < until) GROUP BY u)
SELECT page_id, host, fetch_day, CAST(coalesce(n_lists, 0) AS BIGINT) AS n_lists, coalesce(lists, '') AS lists, matched,
  matched IS NOT NULL AS blocked FROM p LEFT JOIN m ON p.u = m.u"""
