"""Secrets in texts: fixed patterns, and character Markov models for the rest.

Three patterns give the base spans: values assigned to a telling name, access
keys, and runs of hex digits.  Beside them two first-order Markov chains over
characters, one of random strings and one of ordinary identifiers, score every
token of 16 characters or more that no base span holds: the sum over its
transitions of ln p_random - ln p_ordinary, in thousandths of a nat (whole
numbers, so that no order of summation changes a score).  A token is a secret
when it is over ``MIN_ODDS`` times likelier as a random string.  Rare transitions
back off to how often their second character comes at all.

The chains are trained from labelled samples, on distinct strings, so copies weigh nothing.  Ordinary: the tokens outside base
spans of about ``SAMPLE_DOCS`` documents (a bound; drawn by a hash of the text),
the identifiers that these tokens make in a row (CamelCase, with underscores,
hyphens or slashes, in capitals), and runs of one character.  Random: the base finds of the
same documents and ``GENERATED`` strings of each of three forms (hex, base64,
capitals and digits) made from hashes.  The threshold is a constant, and every
text is scanned whole.

DataFrame functions only.  A text stays in its row: ``split`` gives the lengths
between matches, and running sums of these the places.

Defined results: a null text is empty and has no spans; empty texts and tables
give empty results; rows that repeat a doc_id, or a text, are scanned one by one;
a base span and a Markov span may overlap only where the token reaches beyond the
base span; extra columns are carried untouched by ``find_secrets``.  Places are
code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table

# The patterns of the base spans.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
QUOTE = "[\"']?"
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN_MIN, ACCESS, HEX = 12, "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")


def _either_case(pattern: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in pattern)


ASSIGN = (f"({'|'.join(map(_either_case, NAMES))}){QUOTE}\\x20*[:=]\\x20*{QUOTE}({ASSIGN_VALUE}+)")
#: what is cut out before ordinary tokens are taken
KNOWN = f"{ASSIGN}|{ACCESS}|{HEX}"
TOKEN = "[A-Za-z0-9+/_-]+={0,2}"
CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: characters of the chains; all others, and both ends of a string, are state 0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
STATES = len(ALPHABET) + 1
SAMPLE_DOCS = 2000
GENERATED = 1000
RULER = 1000  # length of a run of one character, as ordinary sample
MIN_ODDS = 10_000
MIN_SCORE = round(1000 * math.log(MIN_ODDS))
_BLOCK = 256


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: an expression named inside
    a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), then), 0)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _short_running_sums(xs: Column) -> Column:
    return F.aggregate(xs, F.array().cast("array<long>"), lambda a, x: F.array_append(
        a, x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0))))


def running_sums(xs: Column) -> Column:
    """Inclusive running sums of an array of longs, in blocks: appending to an
    array copies it, so a text with very many matches must not grow one by one."""
    def whole(xs):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / F.lit(_BLOCK)).cast("int")),
                             lambda b: F.slice(xs, b * _BLOCK + 1, _BLOCK))
        return _let(blocks, lambda bs: _let(
            F.concat(F.array(F.lit(0).cast("long")), _short_running_sums(F.transform(bs, _sum))),
            lambda before: F.flatten(F.transform(bs, lambda part, i: F.transform(
                _short_running_sums(part), lambda x: x + F.get(before, i))))))
    none = F.array().cast("array<long>")
    return _let(F.coalesce(xs, none), lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def with_matches(df: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """``out``: array of (start, end, value) of all matches of ``pattern``, value
    being ``group``."""
    hit = F.col(text).rlike(pattern)
    found = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    values = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    gaps = F.when(hit, F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long")))
    df = df.withColumns({"_found": found, "_gaps": gaps, "_values": values if group else found})
    steps = F.transform("_found", lambda x, i: F.get("_gaps", i) + F.when(
        i > 0, F.length(F.get("_found", i - 1))).otherwise(0))
    df = df.withColumn("_starts", running_sums(steps))
    spans = F.transform("_starts", lambda s, i: F.struct(
        s.alias("start"), (s + F.length(F.get("_found", i))).alias("end"), F.get("_values", i).alias("value")))
    return df.withColumn(out, spans).drop("_found", "_gaps", "_values", "_starts")


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """Columns ``_assign``, ``_access`` and ``_hex``."""
    df = with_matches(df, text, ASSIGN, "_assign", group=2)
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["value"]) >= ASSIGN_MIN))
    return with_matches(with_matches(df, text, ACCESS, "_access"), text, HEX, "_hex")


# ---------------------------------------------------------------- the chains
def states(text: Column) -> Column:
    """State numbers of a string's characters, with the ends."""
    inner = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(0)))


def transitions(found: Column) -> Column:
    """Numbers of the transitions between the states of an array."""
    return _let(found, lambda f: F.transform(F.sequence(F.lit(1), F.size(f) - 1),
                                             lambda i: F.get(f, i - 1) * STATES + F.get(f, i)))


def labelled_strings(docs: DataFrame, n: int, sample_docs: int = SAMPLE_DOCS, generated: int = GENERATED) -> DataFrame:
    """Distinct (is_random, string) samples from ``docs`` (text) of ``n`` rows."""
    text = F.coalesce("text", F.lit(""))
    place = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = docs.select(text.alias("t")).where(place < sample_docs / max(n, 1))
    assigned = F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= ASSIGN_MIN)
    known = F.concat(assigned, F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)),
                     F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    plain = F.regexp_extract_all(F.regexp_replace("t", KNOWN, " "), F.lit(TOKEN), F.lit(0))
    drawn = drawn.select(known.alias("known"), plain.alias("plain"))
    joined = lambda by: F.array_join("plain", by)
    camel = F.array_join(F.transform("plain", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(2, 1 << 30))), "")
    names = F.array(joined("_"), joined("-"), joined("/"), F.upper(joined("_")), camel)
    take = lambda label, strings: F.struct(F.lit(label).alias("is_random"), strings.alias("strings"))
    found = drawn.select(F.inline(F.array(take(True, F.col("known")), take(False, F.concat("plain", names)))))
    seed = F.col("id").cast("string")
    made = docs.sparkSession.range(generated).select(F.lit(True).alias("is_random"), F.array(
        F.md5(seed), F.base64(F.unhex(F.sha2(seed, 256))),
        F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(seed, 256))), "[^A-Za-z0-9]", ""))).alias("strings"))
    rulers = docs.sparkSession.range(1, STATES).select(F.lit(False).alias("is_random"), F.array(
        F.repeat(F.substr(F.lit(ALPHABET), F.col("id").cast("int"), F.lit(1)), RULER)).alias("strings"))
    # outer: an inner explode would add a filter that computes the arrays once more
    return (found.unionByName(made).unionByName(rulers).select("is_random", F.explode_outer("strings").alias("string"))
            .where("string IS NOT NULL").distinct())


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, generated: int = GENERATED) -> list[int]:
    """Score of every transition (from * STATES + to) in thousandths of a nat.
    At most 2 * STATES^2 counts reach the driver."""
    strings = labelled_strings(docs, docs.count(), sample_docs, generated)
    moves = strings.select("is_random", F.explode_outer(transitions(states(F.col("string")))).alias("move"))
    counts = {True: [0] * STATES ** 2, False: [0] * STATES ** 2}
    for r in moves.groupBy("is_random", "move").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["is_random"]][r["move"]] = r["n"]

    def chances(c):
        rows = [sum(c[a * STATES:(a + 1) * STATES]) for a in range(STATES)]
        share = [(sum(c[b::STATES]) + 1) / (sum(rows) + STATES) for b in range(STATES)]
        return [(x + STATES * share[m % STATES]) / (rows[m // STATES] + STATES) for m, x in enumerate(c)]
    return [round(1000 * math.log(p / q)) for p, q in zip(chances(counts[True]), chances(counts[False]))]


def log_odds(text: Column, scores: list[int]) -> Column:
    """Thousandths of a nat for the string being random."""
    of = F.split(F.lit(",".join(map(str, scores))), ",").cast("array<long>")  # folded to one literal
    return _sum(F.transform(transitions(states(text)), lambda m: F.get(of, m)))


# ---------------------------------------------------------------- finding
def with_secrets(df: DataFrame, text: str, scores: list[int], out: str = "secrets") -> DataFrame:
    """``out``: array of (start, kind, end, value, score) by start, then kind in
    the order of ``KINDS``; ``score`` is null for base spans."""
    df = with_matches(with_base_spans(df, text), text, CANDIDATE, "_token")
    base = F.concat("_assign", "_access", "_hex")
    alone = F.filter("_token", lambda t: ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    scored = F.transform(alone, lambda t: F.struct(t["start"], t["end"], t["value"],
                                                   log_odds(t["value"], scores).alias("score")))
    df = df.withColumn("_markov", F.when(F.size("_token") > 0, scored)).withColumn(
        "_markov", F.filter(F.coalesce("_markov", F.array()), lambda t: t["score"] > MIN_SCORE))
    none = F.lit(None).cast("long")

    def numbered(k, score):
        return F.transform(f"_{KINDS[k]}", lambda x: F.struct(
            x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["value"].alias("value"),
            score(x).alias("score")))
    parts = [*[numbered(k, lambda x: none) for k in range(3)], numbered(3, lambda x: x["score"])]
    return df.withColumn(out, F.sort_array(F.concat(*parts))).drop(*[f"_{k}" for k in KINDS], "_token")


def find_secrets(docs: DataFrame, scores: list[int] | None = None) -> DataFrame:
    """One row per secret: all columns of its document as ``doc``, ``kind``,
    ``start``, ``end``, ``value`` and ``score``."""
    rows = packed(docs, "text")
    scores = scores if scores is not None else train(rows)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    kinds = F.array(*map(F.lit, KINDS))
    return (with_secrets(rows, "text", scores).select("doc", F.explode_outer("secrets").alias("s"))
            .where("s IS NOT NULL").select("doc", F.get(kinds, F.col("s.k")).alias("kind"), "s.start", "s.end", "s.value", "s.score"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document as spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_secrets(docs, "text", train(docs)).select("doc_id", "secrets")
    kinds = F.array(*map(F.lit, KINDS))
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(
        ":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
                        F.sha2(written(F.filter("secrets", lambda s: s["k"] < 3)), 256).alias("base_sha256"),
                        written(F.col("secrets")).alias("spans"), count(3).alias("n_markov"))


def op11_sql() -> str:
    """The same for DuckDB, match by match and transition by transition."""
    q = lambda p: "'" + p.replace("'", "''") + "'"

    def places(name, pattern, keep):
        return f"""{name}0 AS (SELECT u, unnest(regexp_extract_all(t, {q(pattern)})) AS m,
  unnest(list_slice(regexp_split_to_array(t, {q(pattern)}), 1, len(regexp_extract_all(t, {q(pattern)})))) AS gap,
  unnest(range(len(regexp_extract_all(t, {q(pattern)})))) AS i FROM d),
{name} AS (SELECT u, m, e - length(m) AS s, e FROM (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY u ORDER BY i) AS e
  FROM {name}0) WHERE {keep})"""
    value = f"length(regexp_extract(m, {q(ASSIGN)}, 2)) >= {ASSIGN_MIN}"
    state = lambda i: f"coalesce(strpos('{ALPHABET}', cs[{i}]), 0)"
    moves = f"unnest(list_transform(range(1, len(cs) + 2), lambda i: {state('i - 1')} * {STATES} + {state('i')}))"
    made = ("unnest([md5(g), base64(unhex(sha256(g))), "
            "upper(regexp_replace(base64(unhex(sha256(g))), '[^A-Za-z0-9]', '', 'g'))])")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS u FROM documents),
drawn AS (SELECT t FROM d WHERE CAST('0x' || substr(md5(t), 1, 12) AS BIGINT) / pow(2, 48)
  < {SAMPLE_DOCS}e0 / greatest((SELECT count(*) FROM d), 1)),
plain AS (SELECT regexp_extract_all(regexp_replace(t, {q(KNOWN)}, ' ', 'g'), {q(TOKEN)}) AS w FROM drawn),
strings AS (SELECT DISTINCT r, x FROM (
  SELECT true AS r, unnest(list_filter(regexp_extract_all(t, {q(ASSIGN)}, 2), lambda v: length(v) >= {ASSIGN_MIN})) AS x FROM drawn
  UNION ALL SELECT true, unnest(regexp_extract_all(t, {q(ACCESS)})) FROM drawn
  UNION ALL SELECT true, unnest(regexp_extract_all(t, {q(HEX)})) FROM drawn
  UNION ALL SELECT false, unnest(w) FROM plain
  UNION ALL SELECT false, unnest([array_to_string(w, '_'), array_to_string(w, '-'), array_to_string(w, '/'), upper(array_to_string(w, '_')),
    array_to_string(list_transform(w, lambda v: upper(v[1]) || v[2:]), '')]) FROM plain
  UNION ALL SELECT false, repeat(substr('{ALPHABET}', CAST(i AS INTEGER), 1), {RULER}) FROM range(1, {STATES}) r(i)
  UNION ALL SELECT true, {made} FROM (SELECT CAST(i AS VARCHAR) AS g FROM range({GENERATED}) r(i)))),
mv AS (SELECT r, v, count(*) AS n FROM (SELECT r, {moves} AS v FROM (SELECT r, string_split(x, '') AS cs FROM strings)) GROUP BY r, v),
fr AS (SELECT r, v // {STATES} AS a, sum(n) AS n FROM mv GROUP BY ALL),
bt AS (SELECT r, v % {STATES} AS b, sum(n) AS n FROM mv GROUP BY ALL),
tt AS (SELECT z.r, coalesce(sum(n), 0) AS n FROM (VALUES (true), (false)) z(r) LEFT JOIN mv ON mv.r = z.r GROUP BY z.r),
p AS (SELECT al.r, al.v, (coalesce(mv.n, 0) + {STATES} * ((coalesce(bt.n, 0) + 1) / (tt.n + {STATES}e0)))
    / (coalesce(fr.n, 0) + {STATES}e0) AS p
  FROM (SELECT r, v FROM (VALUES (true), (false)) z(r), range({STATES * STATES}) y(v)) al JOIN tt ON tt.r = al.r
  LEFT JOIN mv ON mv.r = al.r AND mv.v = al.v LEFT JOIN fr ON fr.r = al.r AND fr.a = al.v // {STATES}
  LEFT JOIN bt ON bt.r = al.r AND bt.b = al.v % {STATES}),
sc AS (SELECT x.v, CAST(round_even(1000 * ln(x.p / y.p), 0) AS BIGINT) AS w FROM p x JOIN p y ON x.v = y.v AND x.r AND NOT y.r),
{places('pa', ASSIGN, value)},
{places('pk', ACCESS, 'true')},
{places('ph', HEX, 'true')},
{places('pt', CANDIDATE, 'true')},
base AS (SELECT u, s, 0 AS k, e FROM pa UNION ALL SELECT u, s, 1, e FROM pk UNION ALL SELECT u, s, 2, e FROM ph),
alone AS (SELECT * FROM pt WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.u = pt.u AND b.s <= pt.s AND pt.e <= b.e)),
odd AS (SELECT u, s, e FROM (SELECT u, s, e, {moves} AS v FROM (SELECT u, s, e, string_split(m, '') AS cs FROM alone)) JOIN sc USING (v) GROUP BY u, s, e HAVING sum(w) > {MIN_SCORE}),
al AS (SELECT *, ['{"', '".join(KINDS)}'][k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS x
  FROM (SELECT * FROM base UNION ALL SELECT u, s, 3, e FROM odd)),
g AS (SELECT u, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  count(*) FILTER (k = 3) AS n3, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(x, ',' ORDER BY s, k) AS w FROM al GROUP BY u)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(w, '') AS spans, coalesce(n3, 0) AS n_markov FROM d LEFT JOIN g USING (u)"""
