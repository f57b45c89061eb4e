"""Language identification in two levels.

A text is read as letter trigrams (bytes, lower-cased, everything but letters a
gap); a model's score is the mean of its weights over all trigrams of the whole
text.  First a softmax regression picks the language family, then one-versus-
one linear support vector machines vote between the languages of that family.

The models are fitted on about ``SAMPLE_ROWS`` documents per language, drawn by
hash from the rows that train; prediction reads nothing but the text.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is any text when nothing could be learned; a null doc_id is not held out and
doesn't train; rows that repeat a doc_id are rows of their own; extra columns
are carried untouched by ``predict``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_batches, table

#: documents a language that the models are fitted on, about
SAMPLE_ROWS = 1500
BINS = 2048
UND = "und"
#: language families by ISO 639-1 code; a language outside is its own family
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "semitic": ["ar", "he", "mt", "am"],
}

_IS_LETTER = [65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)]
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _IS_LETTER[c] else 32 for c in range(256))
_T = np.random.default_rng(11).integers(0, 1 << 32, (3, 256), dtype=np.uint32)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all trigrams end to end, and where each text's begin and end."""
    raw = b"".join(b" %b \n" % (t or "").encode("utf-8", "replace").translate(_FOLD) for t in texts)
    a = np.frombuffer(raw, np.uint8)
    gap = a == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    a = a[keep]
    ends = np.flatnonzero(a == 10)
    first = np.r_[0, ends[:-1] + 1]
    if len(a) < 3:
        return np.zeros(0, np.int64), first, np.maximum(first, ends - 2)
    bins = (_T[0][a[:-2]] + _T[1][a[1:-1]] + _T[2][a[2:]]) >> np.uint32(32 - BINS.bit_length() + 1)
    return bins, first, np.maximum(first, ends - 2)


def frequencies(texts: list[str | None]) -> np.ndarray:
    bins, first, end = trigrams(texts)
    out = np.zeros((len(texts), BINS), np.float32)
    for k, (i, j) in enumerate(zip(first, end)):
        if j > i:
            out[k] = np.bincount(bins[i:j], minlength=BINS) / (j - i)
    return out


# -- models -----------------------------------------------------------------------------------
def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Linear support vector machine, hinge loss, dual coordinate descent."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    q, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 300, rate: float = 0.5, decay: float = 1e-4):
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    one = np.eye(k)[y]
    vw = np.zeros_like(w)
    for _ in range(steps):
        z = x @ w + b
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        d = (e / e.sum(axis=1, keepdims=True) - one) / len(x)
        vw = 0.9 * vw - rate * (x.T @ d + decay * w)
        w, b = w + vw, b - rate * d.sum(axis=0)
    return w, b


class Identifier:
    """Family regression and pair machines as one weight row per trigram bin."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(c) for c in self.langs})
        self.members = [[i for i, c in enumerate(self.langs) if family_of(c) == f] for f in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        y = np.array([self.langs.index(c) for c in langs])
        scale = (1 / np.maximum(x.std(axis=0), 1e-4)).astype(np.float32)
        mean = x.mean(axis=0)
        z = (x - mean) * scale / np.sqrt(x.shape[1])
        fam = np.array([self.families.index(family_of(c)) for c in langs])
        w, b = fit_softmax(z, fam, len(self.families))
        columns, bias = [w], [b]
        for i, j in self.pairs:
            rows = np.flatnonzero((y == i) | (y == j))
            wp, bp = fit_svm(z[rows], np.where(y[rows] == i, 1.0, -1.0))
            columns.append(wp[:, None])
            bias.append([bp])
        w = np.concatenate(columns, axis=1) * (scale / np.sqrt(x.shape[1]))[:, None]
        self.weights = w.astype(np.float32)
        self.bias = np.concatenate(bias) - mean @ w

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bins, first, end = trigrams(texts)
        n, f = len(texts), len(self.families)
        s = np.zeros((n, self.weights.shape[1]))
        has = np.flatnonzero(end > first)
        if len(has):
            at = np.stack([first[has], np.minimum(end[has], len(bins) - 1)], axis=1).ravel()
            total = np.add.reduceat(self.weights[bins], at, axis=0, dtype=np.float64)[::2]
            last = end[has] == len(bins)  # reduceat can't end past the array
            total[last] += self.weights[bins[-1]]
            total[last & (end[has] - 1 == first[has])] -= self.weights[bins[-1]]
            s[has] = total / (end[has] - first[has])[:, None]
        s += self.bias
        z = s[:, :f] - s[:, :f].max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        family = p.argmax(axis=1)
        out, score = np.zeros(n, np.int64), p[np.arange(n), family]
        votes = np.zeros((n, len(self.langs)))
        sure = np.zeros((n, len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            m = s[:, f + k]
            q = 1 / (1 + np.exp(-np.clip(2 * m, -50, 50)))
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sure[:, i] += q
            sure[:, j] += 1 - q
        for k, member in enumerate(self.members):
            rows = np.flatnonzero(family == k)
            if len(member) == 1:
                out[rows] = member[0]
                continue
            # most votes, then the larger sum of confidences
            best = (votes[rows][:, member] + sure[rows][:, member] / (2 * len(member))).argmax(axis=1)
            out[rows] = np.array(member)[best]
            score[rows] *= sure[rows, out[rows]] / (len(member) - 1)
        return [self.langs[k] for k in out], score


# -- Spark ------------------------------------------------------------------------------------
def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(lang, x.tobytes()) for lang, text, x in
                zip(b.column(0).to_pylist(), b.column(1).to_pylist(), frequencies(b.column(1).to_pylist()))
                if has_letter(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                          pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Identifier | None:
    """Fitted on rows of ``docs`` (doc_id, text, lang) whose fold is not 0."""
    arrow_batches(docs.sparkSession)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == c, F.lit(sample_rows / n)) for c, n in sorted(counts.items())])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < share * (1 << 20))
    got = sorted((r["lang"], bytes(r["x"])) for r in
                 drawn.select("lang", "text").mapInArrow(_sample_task, "lang string, x binary").collect())
    if not got:
        return None
    x = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(len(got), BINS)
    return Identifier(x, [r[0] for r in got])


def _predict_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            k = b.schema.names.index("text")
            keep = [i for i in range(b.num_columns) if i != k]
            texts = b.column(k).to_pylist()
            lang, score = model.predict(texts) if model else ([UND] * len(texts), np.zeros(len(texts)))
            known = [model is not None and has_letter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep),
                 pa.array([c if y else UND for c, y in zip(lang, known)], pa.string()),
                 pa.array(np.where(known, np.clip(score, 0, 1), 0.0), pa.float64())],
                names=[*(b.schema.names[i] for i in keep), "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Identifier | None) -> DataFrame:
    """``docs`` (must hold ``text``) without the text, with lang_pred and score."""
    arrow_batches(docs.sparkSession)
    schema = StructType([f for f in docs.schema.fields if f.name != "text"]
                        + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(_predict_task(docs.sparkSession.sparkContext.broadcast(model)), schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
