"""Secret scan, filter audit and whitening against plain restatements."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from odd_texts import odd_rows
from pyspark.sql import functions as F

from hydrolens.llm import filter_audit as A
from hydrolens.llm import secret_scan as S
from hydrolens.llm import whitening as W


# ---------------------------------------------------------------- secrets
def _base(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                         text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


HEX = hashlib.md5(b"x").hexdigest()
HARD = [
    f"é password={HEX} ü", "token: secret: abcdefghijklmnop", "API_KEY = 'abcdefghijkl' apikey:'short'",
    "AKIA" + "Z" * 13, "xAKIA" + "AKIA" * 5 + " AKIA1234567890123", HEX + "g" + HEX, "😀" * 3 + HEX, None, "",
    "secret==abcdefghijklmn", "paſſword=abcdefghijklmnop", " ".join([HEX] * 700), "token=" + "A" * 12 + "é" + "B" * 20]


def test_base_spans(spark):
    texts = HARD + [r[1] for r in odd_rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn(
        "text", F.coalesce("text", F.lit("")))
    got = {r["doc_id"]: [(s["start"], s["k"], s["end"]) for s in r["secrets"] if s["k"] < 3]
           for r in S.with_secrets(df, "text", [0] * S.STATES ** 2).collect()}
    assert got == {i: _base(t or "") for i, t in enumerate(texts)}


def test_random_strings_are_found_and_words_are_not(spark, small):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ["".join(rng.choice(letters) for _ in range(n)) for n in (20, 24, 32, 40, 64) * 4]
    plain = ["internationalisation", "get_the_other_document", "THE_OTHER_CONSTANT_NAME", "-" * 40,
             "some-hyphenated-and-ordinary-name"]
    rows = [(10 ** 6 + i, f"und so é {x} etc") for i, x in enumerate(planted + plain)]
    docs = spark.createDataFrame(list(small) + rows, "doc_id long, text string")
    got = {(r["id"], r["value"]) for r in S.find_secrets(docs).where("kind = 'markov'")
           .select(F.col("doc.doc_id").alias("id"), "value").collect()}
    want = {(10 ** 6 + i, x) for i, x in enumerate(planted)}
    assert want <= got and not {x for _, x in got} & set(plain)


def test_log_odds_against_a_plain_sum(spark):
    rng = random.Random(1)
    scores = [rng.randrange(-9000, 9000) for _ in range(S.STATES ** 2)]
    words = ["abc", "Z9+/=_-", "a", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(S.log_odds(F.col("w"), scores)).collect()]
    at = lambda c: S.ALPHABET.index(c) + 1
    for w, g in zip(words, got):
        chain = [0, *map(at, w), 0]
        assert g == sum(scores[a * S.STATES + b] for a, b in zip(chain, chain[1:]))


def test_running_sums_pass_a_block(spark):
    n = 3 * S._BLOCK + 5
    df = spark.createDataFrame([([i % 7 for i in range(n)],), ([],), ([4],)], "a array<long>")
    got = [r[0] for r in df.select(S.running_sums(F.col("a"))).collect()]
    assert got == [list(np.cumsum([i % 7 for i in range(n)])), [], [4]]


def test_odd_documents_keep_their_columns(odd, empty):
    got = S.find_secrets(odd)
    assert got.select("doc.*").columns == odd.columns and got.count() >= 0
    assert S.find_secrets(empty).count() == 0


# ---------------------------------------------------------------- audit
def _audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = {}
    for i, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
               "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
               "E": i is not None and first[t] < i}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                r = rows.setdefault((part or "", order, step), [0] * 6)
                r[0] += not gone and not bad[f]
                r[1] += not gone and bad[f]
                r[2] += gone and bad[f]
                r[3] += bad[f] and sum(bad.values()) == 1
                r[4] += not gone and bad[f] and i is not None and i in good
                r[5] += not gone and bad[f] and i is not None and i in toxic
                gone = gone or bad[f]
    shap = {}
    for (p, order, step), r in rows.items():
        k = p, order[step - 1]
        shap[k] = shap.get(k, 0) + r[1]
    return {(*k, *v, shap[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_audit_against_brute_force(spark, odd, empty):
    rows = odd_rows()
    docs = [(r[0], r[1], r[3]) for r in rows]
    labels = [(5, 1, 1), (5, None, 0), (9, 1, None), (None, 1, 1), (13, 0, 1), (41, 1, 0), (41, 1, 0), (777, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    take = lambda df: df.select("doc_id", "text", F.col("source").alias("part"), "kept")
    got = A.audit(A.with_labels(A.masked(take(odd)), lab))
    assert set(map(tuple, got.select("part", "filter_order", "step", *A.COUNTS).collect())) == _audit(docs, labels)
    assert A.audit(A.with_labels(A.masked(take(empty)), lab)).count() == 0


def test_fields_hold_large_counts():
    n = (1 << 62) + 12345
    total = sum(n // 32 * x for x in A.mask_integers())
    got = A.unpack(total)
    assert got[0, 0, 0] == got[0, 0, 1] == n // 32 * 16  # half of the masks fail any filter


# ---------------------------------------------------------------- whitening
def _reference(x):
    u = np.unique(x, axis=0).astype(float)
    w, q = np.linalg.eigh(np.cov(u.T, bias=True))
    return (x - u.mean(0)) @ q[:, ::-1] / np.sqrt(np.maximum(w[::-1], 1e-300)), w[::-1] / w.sum()


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12)) * np.linspace(3, .2, 12)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)] + [(900, [float(c) for c in v[0]])] * 40
    rows += [(901, None), (902, [1.0, None] + [0.0] * 10), (903, [float("nan")] * 12), (904, [float("inf")] * 12),
             (905, [1.0, 2.0]), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).repartition(5)
    out, model = W.whiten_table(df)
    got = {r["doc"]["vec_id"]: r for r in out.collect()}
    assert set(got) == {*range(300), 900} and out.count() == 340 and out.select("doc.*").columns == df.columns
    x = np.floor(256 * v).astype("int64")
    want, shares = _reference(x)
    for k in range(4):
        col = np.array([got[i]["whitened"][k] for i in range(300)])
        assert np.allclose(np.abs(col), np.abs(want[:, k]), atol=1e-9)
        assert np.allclose(col * np.sign(col[0]), want[:, k] * np.sign(want[0, k]), atol=1e-9)
    assert np.allclose(model.explained, shares[:4], rtol=1e-10) and model.identity_error < 1e-9
    s = x.sum(0)
    assert got[7]["deviation"] == int(((300 * x[7] - s) ** 2).sum()) and model.n == 300


def test_equal_eigenvalues_zero_variance_and_large_entries(spark):
    def run(vs):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
        out, model = W.whiten_table(df)
        return out.collect(), model
    eye = [[1.0 * (i == j) for j in range(5)] for i in range(5)]  # one eigenvalue four times
    rows, model = run(eye)
    assert len(model.values) == 4 and np.allclose(model.values, model.values[0]) and model.identity_error < 1e-9
    rows, model = run([[1.0, 2.0]] * 7)
    assert len(rows) == 7 and rows[0]["whitened"] == [] and rows[0]["deviation"] == 0 and model.n == 1
    rows, model = run([[1e17, 0.0, 1.0], [0.0, 1.0, -2e17], [3e15, 5.0, 7.0]])
    assert len(model.values) == 2 and model.identity_error < 1e-6 and all(r["deviation"] is None for r in rows)
    rows, model = run([])
    assert rows == [] and model is None


@pytest.mark.parametrize("d", [1, 2, 7])
def test_characteristic_polynomial(spark, d):
    rng = np.random.default_rng(d)
    b = rng.integers(-50, 50, size=(d, d)).astype(object)
    b[:, 0] = 0 if d == 7 else b[:, 0]
    m = (b @ b.T).tolist()
    poly = W.characteristic_polynomial(spark, m)
    for t in (-3, 0, 11):  # det(tI - m) by cofactors
        def det(a):
            return a[0][0] if len(a) == 1 else sum((-1) ** j * a[0][j] * det([r[:j] + r[j + 1:] for r in a[1:]])
                                                   for j in range(len(a)))
        assert sum(c * t ** i for i, c in enumerate(poly)) == det(
            [[(t if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)])
