"""SimHash groups, suffix dedup, sharding."""

import random

import numpy as np
from brute import fingerprint, groups, removed
from odd_texts import SF, odd_rows

from hydrolens.llm import sharding as H
from hydrolens.llm import simhash as S
from hydrolens.llm import suffix_dedup as X


def test_simhash_query(spark, small):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.op10_simhash(spark, SF).collect())
    f = [fingerprint(t) for _, t in small]
    ids = [d for d, _ in small]
    assert got == [(d, f"{x:016x}", ids[c]) for d, x, c in zip(ids, f, groups(f))]


def test_odd_groups(odd, empty):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    f = [fingerprint(r[1]) for r in rows]
    want = [(rows[i][0], f[i], rows[c][0]) for i, c in enumerate(groups(f))]
    for nodes in (S.BUCKET_NODES, 2):
        got = S.group_documents(odd.select("doc_id", "text"), bucket_nodes=nodes).collect()
        assert sorted(map(str, ((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got))) == sorted(map(str, want))
    kept = S.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want if c is not None})
    assert S.one_per_group(empty).count() == 0
    assert S.group_documents(empty.select("doc_id", "text")).count() == 0


def test_near_pairs_match_counting():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    f = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), replace=False))
                            for b in base for _ in range(30)], np.uint64))
    for bits in (0, 1, 2, 3, 4):
        q, k = S.near_pairs(f[::3], f, bits)
        want = {(i, j) for i, a in enumerate(f[::3].tolist()) for j, b in enumerate(f.tolist())
                if (a ^ b).bit_count() <= bits}
        assert set(zip(q.tolist(), k.tolist())) == want


def test_components_of_chains(spark):
    rng = random.Random(2)
    names = rng.sample(range(-10**12, 10**12), 400)
    edges = [(names[i], names[i + 1]) for i in range(199)] + [(names[200], names[i]) for i in range(201, 400)]
    df = spark.createDataFrame(rng.sample(edges, len(edges)), "a long, b long")
    got = {r.fp: r.root for r in S.components(df).collect()}
    want = {n: min(names[:200]) for n in names[:200]} | {n: min(names[200:]) for n in names[200:]}
    assert {n: got.get(n, n) for n in names} == want


def test_suffix_dedup_query(spark, small):
    got = sorted(map(tuple, X.op9_suffix_dedup(spark, SF).collect()))
    assert got == [(d, *r) for (d, _), r in zip(small, removed(small))]


def test_suffix_dedup_odd(odd, empty):
    rows = [r[:2] for r in odd_rows() if r[0] not in (12, 13)] + [(r[0], r[1][:3000]) for r in odd_rows() if r[0] in (12, 13)]
    from pyspark.sql import functions as F
    df = odd.withColumn("text", F.when(F.col("doc_id").isin(12, 13), F.substring("text", 1, 3000)).otherwise(F.col("text")))
    want = sorted(str((d, *r)) for (d, _), r in zip(rows, removed(rows)))
    for hot, bucket, memory in ((X.HOT_BLOCKS, X.BUCKET_BYTES, X.MEMORY_BYTES), (1, 3000, 500)):
        got = X.remove_repeats(df, hot, bucket, memory).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert X.remove_repeats(empty).count() == 0


def test_order_is_the_sorted_suffixes():
    rng = random.Random(3)
    strings = list({bytes(rng.choices(b"abc", k=rng.randint(6, 30))) for _ in range(200)})
    least = np.arange(len(strings))[::-1] * 10
    files = X.ColumnFiles("file:///nowhere")
    got, begin = X.least_holders(strings, least, files, match=6)
    for i, s in enumerate(strings):
        for o in range(len(s) - 5):
            assert got[begin[i] + o] == min(least[j] for j, t in enumerate(strings) if s[o:o + 6] in t)


def test_a_bucket_travels_as_one_row_and_is_ordered_in_parts(monkeypatch):
    import pyarrow as pa
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=1500)).encode() for _ in range(4)]
    blocks = [texts[:2] + [texts[3]], [texts[2], texts[0][1000:6000], texts[3]]]
    names, kinds = ("doc_ids", "lengths", "texts", "pieces"), [("block", pa.int64()), ("n_bytes", pa.int64())]
    rows = []
    for k, docs in enumerate(blocks):
        lengths = np.array([len(t) for t in docs], "<i8")
        rows.append({"block": k, "n_bytes": int(lengths.sum()), "doc_ids": (np.arange(3) + 3 * k).astype("<i8").tobytes(),
                     "lengths": lengths.tobytes(), "texts": X.zstandard.ZstdCompressor().compress(b"".join(docs)),
                     "pieces": X.find_pieces(b"".join(docs), lengths)})
    schema = pa.schema(kinds + [(c, pa.binary()) for c in names])
    anchors = pa.Table.from_batches(list(X._send_anchors(1)(pa.RecordBatch.from_pylist([r], schema=schema) for r in rows)))
    marks = X._mark_anchors(1000)(anchors)
    sent = pa.concat_tables([X._send_pieces(1)(pa.Table.from_pylist([r], schema=schema),
                                               marks.filter(pa.compute.equal(marks["block"], r["block"]))) for r in rows])
    assert sent.num_rows == 2  # one row per block and bucket
    orders, build = [], X.least_holders
    monkeypatch.setattr(X, "least_holders", lambda strings, *a: orders.append(set(strings)) or build(strings, *a))
    told = X._order_bucket("file:///nowhere")(sent)
    assert told["block"].to_pylist() == [0, 1]
    every = set().union(*orders)
    assert len(orders) == X.PARTS and sum(map(len, orders)) == len(every)  # no string in two parts
    assert max(map(len, orders)) < len(every) / 2
    kind = lambda t, k: t.append_column("kind", pa.array([k] * t.num_rows))
    met = pa.concat_tables([kind(marks, 1), kind(told, 2)])
    docs = [(i, t) for i, t in enumerate(blocks[0] + blocks[1])]
    got = [r for k in (0, 1) for r in X._remove(1)(pa.Table.from_pylist([rows[k]], schema=schema), met.filter(
        pa.compute.equal(met["block"], k))).to_pylist()]
    assert [tuple(r.values()) for r in got] == [(d, *r) for (d, _), r in zip(docs, removed(
        [(d, t.decode()) for d, t in docs]))]


def test_sharding(spark, odd, empty):
    rows = odd_rows()
    out = H.shard_documents(odd, n_shards=4).collect()
    assert sorted(str((r.doc.doc_id, r.doc.text)) for r in out) == sorted(str(r[:2]) for r in rows)
    sizes = [sum(r.shard == s for r in out) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in enumerate(sizes))
    assert all(r.size == len((r.doc.text or "").encode()) + 1 for r in out)
    assert H.shard_documents(empty).count() == 0
    got = H.op5_sharding(spark, SF).toPandas()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and got.doc_id.is_unique
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = H.op5_sharding(spark, SF).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_equal_rows_are_shuffled_apart(spark):
    rows = [(i, f"text {i}", "en", "a") for i in range(400) for _ in range(2)] + [(-1, "same", "en", "a")] * 400
    out = H.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    pairs = out[out.doc_id >= 0].groupby("doc_id").shard.nunique()
    assert (pairs == 1).mean() < 0.2
    same = out[out.doc_id < 0]
    assert same.groupby("shard").size().reindex(range(16), fill_value=0).between(10, 40).all()
    back = same.sort_values(["shard", "slot"])
    assert (back.groupby("shard").slot.diff() == 1).mean() < 0.5


def test_matrix_is_that_of_a_random_permutation():
    parts, shards = [7, 0, 12, 5], [6, 6, 6, 6]
    draws = np.array([H.communication_matrix(parts, shards, s) for s in range(4000)])
    assert (draws.sum(axis=2) == parts).all() and (draws.sum(axis=1) == shards).all()
    rng = np.random.default_rng(0)
    want = rng.multivariate_hypergeometric(shards, 7, 4000)
    assert np.allclose(draws[:, 0].mean(axis=0), want.mean(axis=0), atol=0.1)
    assert np.allclose(draws[:, 2].var(axis=0), rng.multivariate_hypergeometric(shards, 12, 4000).var(axis=0), atol=0.15)
    assert H.hypergeometric(random.Random(1), 10**12, 10**12, 10**6) > 0
