"""Mixing, licences, language identification."""

import textwrap

import numpy as np
import pytest
from odd_texts import SF, odd_rows
from pyspark.sql import functions as F

from hydrolens.llm import language_id as L
from hydrolens.llm import licences as C
from hydrolens.llm import mixing as M

BIG = "/root/testdata/sf0.01"


def test_mixing_meets_targets(spark):
    got = M.op2_mixing(spark, BIG).toPandas()
    n, total = got.n_tokens, got.n_tokens.sum()
    for d, w in M.TARGETS.items():
        assert abs((n * got.rate * got[f"p_{d}"]).sum() / total - w) < 0.003
    p = got[[f"p_{d}" for d in M.TARGETS]]
    assert np.allclose(p.sum(axis=1), 1) and (got.rate >= 0).all()
    assert abs(got.copies.sum() - got.rate.sum()) < 0.1 * len(got)
    labels = spark.read.parquet(f"{BIG}/labels.parquet").toPandas().merge(got, on="doc_id")
    want = np.where(labels.toxic == 1, "toxic", np.where(labels.quality == 1, "good", "poor"))
    cols = [f"p_{d}" for d in sorted(M.TARGETS)]
    assert (np.array(sorted(M.TARGETS))[labels[cols].to_numpy().argmax(axis=1)] == want).mean() > 0.95


def test_rates_are_the_brute_force_minimum(spark):
    r = np.random.default_rng(3)
    n = r.integers(1, 50, 40)
    p = r.dirichlet([0.3, 0.3], 40)
    df = spark.createDataFrame([(int(a), float(x), float(y)) for a, (x, y) in zip(n, p)], "n_tokens long, p_a double, p_b double")
    ridge, targets = 0.05, {"a": 0.8, "b": 0.2}
    rate, want, _ = M.fit_rates(df, ["a", "b"], targets, ridge=ridge, steps=30)
    got = np.array([x[0] for x in df.select(rate).collect()])
    t0 = (n[:, None] * p).sum(axis=0)
    goal = np.array([want["a"], want["b"]])
    x = np.ones(40)
    for _ in range(20000):
        e = ((n * x) @ p - goal) / t0
        x = np.maximum(0, x - 0.2 * (p @ e + ridge * (x - 1)))
    rows = df.collect()
    order = {(a.n_tokens, a.p_a): g for a, g in zip(rows, got)}
    assert np.allclose([order[int(a), float(b[0])] for a, b in zip(n, p)], x, atol=2e-3)


def test_soft_memberships_reach_the_least_squares_answer(spark):
    domains = ["good", "poor", "toxic"]
    for alpha, seed in ((0.3, 1), (2.0, 2), (30.0, 3)):
        r = np.random.default_rng(seed)
        n, p = r.integers(20, 400, 4000), r.dirichlet([alpha] * 3, 4000)
        df = spark.createDataFrame([(int(a), *map(float, x)) for a, x in zip(n, p)],
                                   "n_tokens long, " + ", ".join(f"p_{d} double" for d in domains))
        rate, want, now = M.fit_rates(df, domains, M.TARGETS)
        got = df.select("n_tokens", *[f"p_{d}" for d in domains], rate.alias("rate")).toPandas()
        n, x, q = got.n_tokens.to_numpy(), got.rate.to_numpy(), got[[f"p_{d}" for d in domains]].to_numpy()
        t = (n * x) @ q
        assert np.allclose(t, [now[d] for d in domains])
        # conditions of the minimum: the gradient is zero, or positive at rate zero
        g = q @ ((t - [want[d] for d in domains]) / (n @ q)) + M.RIDGE * (x - 1)
        assert (x >= 0).all() and np.abs(g[x > 0]).max() < 1e-6 and g[x == 0].min(initial=0) > -1e-6
    with pytest.raises(RuntimeError):
        M.fit_rates(df, domains, M.TARGETS, steps=1)


def test_posteriors_carry_the_prior_of_the_label_table(spark):
    # texts that tell nothing, one toxic label in ten
    r = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.integers(0, 30, 40))) for i in range(2000)],
                                 "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    M.arrow_batches(spark)
    for sample in (150, 2000):
        domains, par = M.train(docs, labels, sample_rows=sample)
        p = M.posteriors(docs, domains, par).toPandas().p_toxic
        assert 0.05 < p.mean() < 0.18, sample


def test_mixing_odd(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (9, None, 1), (30, 0, None), (777, 1, 1), (1, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    out = M.mix(odd, labels)
    assert out.columns == odd.columns
    assert {(r.doc_id, r.text) for r in out.collect()} <= {r[:2] for r in odd_rows()}
    assert M.mix(empty, labels).count() == 0
    # without labels there is one domain, every rate is 1
    assert M.mix(odd, labels.where("1 = 0")).count() == odd.count()


def test_words_are_split_like_plain_text():
    texts = [r[1] for r in odd_rows()]
    n, doc, word, shapes = M.features(texts)
    assert n.tolist() == [len((t or "").encode().split()) for t in texts]
    kinds = np.bincount(doc, minlength=len(texts))
    assert all(k == len(set((t or "").encode().lower().split())) for t, k in zip(texts, kinds) if len(t or "") < 2000)


def test_language_held_out(spark):
    got = L.op8_language_id(spark, BIG).toPandas()
    want = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    held = want[want.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_language_odd(odd, empty):
    model = L.train(odd.select("doc_id", "text", "lang"))
    got = L.predict(odd.select("doc_id", "text"), model).collect()
    assert len(got) == len(odd_rows())
    none = {1, 2, 3}
    assert all(r.lang_pred == L.UND and r.score == 0 for r in got if r.doc_id in none)
    assert all(r.lang_pred != L.UND for r in got if r.doc_id not in none | {None})
    assert L.train(empty.select("doc_id", "text", "lang")) is None
    assert {r.lang_pred for r in L.predict(odd.select("text"), None).collect()} == {L.UND}
    assert L.predict(empty.select("text"), model).count() == 0


def test_score_is_the_mean_over_trigrams():
    texts = [r[1] for r in odd_rows() if len(r[1] or "") < 3000]
    x = L.frequencies(texts)
    rng = np.random.default_rng(2)
    model = L.Identifier(rng.random((40, L.BINS)).astype(np.float32) * 0.01, ["en", "de", "fr", "es"] * 10)
    s = x.astype(float) @ model.weights + model.bias
    fam = s[:, :len(model.families)].argmax(axis=1)
    lang, _ = model.predict(texts)
    for t, k, row in zip(lang, fam, s):
        i, j = model.members[k]
        m = row[len(model.families) + model.pairs.index((i, j))]
        if abs(m) > 1e-4:
            assert t == model.langs[i if m > 0 else j]


LINES = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
         "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
         "Licensed under the Apache License, Version 2.0.": "apache-2.0"}


def test_licences(spark, odd, empty):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.families for r in C.op6_licences(spark, BIG).collect()}
    for d, t in docs.collect():
        assert got[d] == ",".join(sorted({LINES[x] for x in (t or "").split("\n") if x in LINES}))
    model = C.train(docs)
    found = C.scan(odd, model).selectExpr("doc.doc_id AS d", "family", "confirmed").collect()
    assert [(r.d, r.family) for r in found if r.confirmed] == [(70, "apache-2.0")]
    assert C.scan(empty, model).count() == 0
    assert C.train(empty.select("doc_id", "text")).threshold >= 0.5


def test_probes_miss_no_paragraph_with_a_feature(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = C.train(docs)
    lines = C.paragraphs(docs).withColumn("_w", C.words(F.col("paragraph")))
    rows = C._vectors(lines, model.vocabulary).select(model.may_match(F.col("paragraph")).alias("may"), "_x")
    got = rows.collect()
    assert any(r["_x"].numNonzeros() for r in got)
    assert all(r["may"] for r in got if r["_x"].numNonzeros())


def _notices():
    """(text, family): every template in one line, wrapped, and behind comment signs."""
    out = []
    for family, texts in C.TEMPLATES.items():
        for t in texts:
            lines = textwrap.wrap(t, 72)
            for mark in ("", "# ", "// ", " * "):
                out.append(("Some words.\n\n" + "\n".join(mark + x for x in lines) + f"\n{mark}\nMore words here.", family))
            out.append((t, family))
    return out


def _found(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in C.scan(df, model).where("confirmed").selectExpr("doc.doc_id AS d", "family").collect():
        got[r.d].add(r.family)
    return got


def test_licence_notices_wrapped_and_told_apart(spark):
    model = C.train(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text"))
    cases = _notices()
    # versions that no template has
    gnu = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation; either version {} of the License, or any later version.")
    cases += [(gnu.format(1), None), (gnu.format(4), None)]
    got = _found(spark, model, [t for t, _ in cases])
    wrong = [(t, f, got[i]) for i, (t, f) in enumerate(cases) if got[i] != ({f} if f else set())]
    assert not wrong, wrong[:5]


def test_lines_with_a_notice_do_not_train_as_unknown(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    line = "Copyright 2021 X. Licensed under the MIT License."
    hot = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(line + "\n"), "text")).otherwise(F.col("text")))
    model = C.train(hot)
    assert "licensed" in model.probes and model.threshold < 0.99
    assert _found(spark, model, [line])[0] == {"mit"}
