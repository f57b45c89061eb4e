"""Host quality, URL lists, decontamination."""

from brute import decontaminate, measures
from odd_texts import odd_rows

from hydrolens.llm import decontaminate as D
from hydrolens.llm import host_quality as H
from hydrolens.llm import url_lists as U


def _rows(df, *cols):
    return sorted(map(str, map(tuple, df.select(*cols).collect())))


def test_measures_of_odd_rows(odd):
    got = H.measure(odd.select("doc_id", "text")).select("doc_id", "text", *H.MEASURES).collect()
    for r in got:
        assert tuple(r[2:]) == measures(r.text), r.doc_id


def test_letters_and_form_feeds_at_the_ends(spark):
    fifty = " ".join(f"w{i}" for i in range(49))
    texts = ["of of of", "f of of of", "fff", "\x0cf a b f\x0c", "\x0b\x0cone two\x0c", "\x0c", fifty + " f", "ff " + fifty,
             "\x0c" + fifty + "\x0c", "tnr x0bu", "a \u2028", "\u0085 b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = H.measure(df).select("text", *H.MEASURES).collect()
    for r in got:
        assert tuple(r[1:]) == measures(r.text), repr(r.text)


def test_quality_filter_keeps_rows_whole(odd, empty):
    kept = H.quality_filter(odd)
    assert kept.columns == odd.columns
    want = [r[:2] for r in odd_rows() if not measures(r[1])[-1]]
    assert _rows(kept, "doc_id", "text") == sorted(map(str, want))
    assert H.quality_filter(empty).count() == 0


def test_bad_host_is_rejected_and_small_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = ([(i, "bad", "x") for i in range(300)] + [(1000, "bad", good)]
            + [(2000 + i, f"h{i % 20}", good) for i in range(400)] + [(9000, "tiny", "x"), (9001, "tiny", good)])
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = {r.doc_id for r in H.quality_filter(df).select("doc_id").collect()}
    assert 1000 not in kept and 9001 in kept and len(kept) == 401


def test_hot_key_join(spark):
    from pyspark.sql import functions as F

    from hydrolens.llm.common import join_on_hot_key
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
                                   .otherwise(F.col("id").cast("string")).alias("k"))
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small = counts.select("k", (F.col("n") * 2).alias("v")).where("k IS NULL OR k <> '5'")
    got = {(r.id, r.k, r.v) for r in join_on_hot_key(big, small, "k", counts, 3000).collect()}
    n = {r.k: r.n for r in counts.collect()}
    assert got == {(r.id, r.k, None if r.k == "5" else 2 * n[r.k]) for r in big.collect()}


ITEMS = [("1", "alpha0 beta0 gamma0 alpha1 beta1 gamma1 alpha2 beta2 gamma2 alpha3 beta3 gamma3 alpha4 beta4"),
         ("10", "one two"), ("2", "w5x5"), ("3", ""), ("4", None), (None, "one"), ("2", "be be be"), ("6", "é" * 60)]


def test_windows_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    clash = odd.select("doc_id", "text")
    for block in (D.BLOCK_BYTES, 40):
        got = D.find_items(clash, items, block_bytes=block)
        from pyspark.sql import functions as F
        got = got.select("text", "n_words", "n_hit", F.size("items").alias("n"),
                         F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("s"), "contaminated")
        for r in got.collect():
            assert tuple(r[1:]) == decontaminate(r.text, ITEMS), (r.text or "")[:40]
    cleaned = D.clean(odd, items)
    assert cleaned.columns == odd.columns
    assert _rows(cleaned, "doc_id", "text") == sorted(
        str(r[:2]) for r in odd_rows() if not decontaminate(r[1], ITEMS)[-1])
    assert D.clean(empty, items).count() == 0 and D.clean(odd, items.where("1 = 0")).count() == odd.count()


def test_search_finds_what_find_finds():
    import random
    r = random.Random(4)
    vocab = ["a", "b", "ab", "ba", "aba", "1", "é"]
    for _ in range(60):
        texts = [" ".join(r.choices(vocab, k=r.randint(0, 400))) for _ in range(4)]
        items = [(str(k), " ".join(r.choices(vocab, k=r.randint(0, 16)))) for k in range(6)]
        n_words, runs, found = D.WindowSet(items, window=5).scan(texts)
        for i, t in enumerate(texts):
            w, cover, met = t.split(), set(), set()
            for item, b in items:
                b = b.split()
                size = min(5, len(b))
                for x in range(len(b) - size + 1 if b else 0):
                    for y in range(len(w) - size + 1):
                        if w[y:y + size] == b[x:x + size]:
                            cover.update(range(y, y + size))
                            met.add(item)
            assert n_words[i] == len(w) and found.get(i, set()) == met
            assert {p for a, b in runs.get(i, []) for p in range(a, b)} == cover


def test_url_lists_edges(spark):
    import datetime as dt
    day = lambda n: dt.date(2024, 1, n)
    events = spark.createDataFrame([
        ("x", "b.org", day(5), "add"), ("x", "b.org", day(10), "remove"), ("x", "b.org", day(20), "add"),
        ("y", "c.net/p", day(1), "add"), ("y", "d.com", day(3), "add"), ("y", "d.com", day(3), "remove"),
        (None, "b.org", day(1), "add"), ("x", None, day(1), "add"), ("x", "e.com", None, "add"), ("x", "e.com", day(1), "?"),
    ], "list string, pattern string, day date, action string")
    captures = spark.createDataFrame([
        (1, "http://A.b.org/q", day(4)), (2, "https://u@a.b.org:80/q?x", day(5)), (3, "http://b.org", day(10)),
        (4, "http://b.org./", day(25)), (5, "http://c.net/p/z#f", day(9)), (6, "http://c.net/pz", day(9)),
        (7, "http://d.com/", day(9)), (8, None, day(9)), (9, "nonsense", day(9)), (10, "http://b.org", None),
        (2, "https://u@a.b.org:80/q?x", day(5)), (11, "http://e.com", day(9)), (12, "http://xb.org", day(6)),
    ], "page_id int, url string, day date").selectExpr("*", "-1 AS host", "-1 AS lists", "-1 AS blocked", "-1 AS site")
    got = U.evaluate(captures, events).selectExpr("doc.page_id AS p", "lists", "matched", "blocked", "doc.host AS h").collect()
    assert sorted((r.p, r.lists, r.matched) for r in got if r.blocked) == [
        (2, ["x"], "b.org"), (2, ["x"], "b.org"), (4, ["x"], "b.org"), (5, ["y"], "c.net/p"), (7, ["y"], "d.com")]
    assert len(got) == 13 and all(r.h == -1 for r in got)
    assert U.evaluate(captures.where("1 = 0"), events).count() == 0
    assert U.evaluate(captures, events.where("1 = 0")).where("blocked").count() == 0


def test_very_long_items_and_words():
    big, other = "a" * 100_000, " ".join("word%d" % i * 900 for i in range(15))
    items = [("big", big), ("two", "b" * 40_000 + " " + "c" * 40_000), ("other", other), ("big", big)]
    texts = [f"x {big} y", "a" * 99_999, f"{'b' * 40_000} {'c' * 40_000}", other, None]
    n_words, runs, found = D.WindowSet(items).scan(texts)
    assert [sorted(found.get(i, ())) for i in range(5)] == [["big"], [], ["two"], ["other"], []]
    assert list(n_words) == [3, 1, 2, 15, 0] and D.merge_runs(runs[3]) == [[0, 15]]


def test_repeated_items_are_one(spark):
    bench = spark.createDataFrame([("i1", "some words that are in it")] * 500, "item_id string, text string")
    docs = spark.createDataFrame([(1, "here some words that are in it too")], "doc_id long, text string")
    r = D.find_items(docs, bench, block_bytes=30).first()
    assert r["items"] == ["i1"] and r["n_hit"] == 6
