"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are trained by follow-the-regularised-leader (per-coordinate
steps, elastic-net penalty: most weights stay 0) on a bounded sample of
labelled documents; a temperature fitted on a part of the sample kept aside
turns scores into calibrated probabilities.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, rows_of

#: Documents used to fit the classifier at most, shared evenly by the languages; and languages learned at most, the most frequent ones.
SAMPLE, LANGUAGES = 2400, 400
DIMS = 1 << 13
UNKNOWN = "und"
#: Characters hashed at once.
CHUNK = 1 << 18


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return table


_TABLE: list[np.ndarray] = []


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of the letters of the whole text in lower case, other characters as one blank; None without letters."""
    if not _TABLE:
        _TABLE.append(_letters())
    out = np.zeros(DIMS, np.int64)
    some = False
    for at in range(0, max(1, len(text)), CHUNK):
        code = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _TABLE[0][code]
        if not letter.any():
            continue
        some = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # a blank after each word
        c = np.where(letter, code, 32)[keep].astype(np.uint32)
        c = np.concatenate([[np.uint32(32)], c])
        a = c * np.uint32(0x9E3779B1)
        b = a[1:] * np.uint32(0x85EBCA6B) + c[:-1] * np.uint32(0xC2B2AE35)
        d = b[1:] * np.uint32(0x27D4EB2F) + c[:-2] * np.uint32(0x165667B1)
        for h in (a, b, d):
            out += np.bincount((h ^ h >> np.uint32(15)) >> np.uint32(19), minlength=DIMS)
    return out if some else None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the counts n at these places, others being 0."""
        x = np.log1p(n) * self.idf[at]
        size = np.sqrt((x * x).sum())
        return x / size if size else x

    def scores(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text) if text and self.langs else None
        if n is None:
            return UNKNOWN, 0.0
        at = np.flatnonzero(n)
        s = self.scores(at, n[at]) / self.heat
        p = np.exp(s - s.max())
        k = int(s.argmax())
        return self.langs[k], float(p[k] / p.sum())


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 0.5, l1: float = 2e-3, l2: float = 1e-3) -> Model:
    """rows: (language, places of counts, counts there: none is 0).  Every fifth row sets the temperature, the others the weights."""
    langs = sorted({r[0] for r in rows})
    held = rows[::5] if len(rows) >= 50 else []
    train = [r for i, r in enumerate(rows) if i % 5] if held else rows
    seen = np.zeros(DIMS)
    for _, at, _ in train:
        seen[at] += 1
    model = Model(langs, np.log((1 + len(train)) / (1 + seen)) + 1, np.zeros((DIMS, len(langs))), np.zeros(len(langs)), 1.0)
    if len(langs) < 2:
        return model
    data = [(np.append(at, at.dtype.type(DIMS)), np.append(model.vector(at, n), 1.0), langs.index(lang)) for lang, at, n in train]  # the last coordinate is the bias
    z, q = np.zeros((DIMS + 1, len(langs))), np.zeros((DIMS + 1, len(langs)))
    edge = np.append(np.full(DIMS, l1), 0.0)[:, None]

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= edge[at], 0.0, (np.sign(zz) * edge[at] - zz) / ((1.0 + np.sqrt(q[at])) / rate + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            at, x, k = data[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1.0
            g = x[:, None] * p
            new = q[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(q[at])) / rate * w
            q[at] = new
    every = weights(np.arange(DIMS + 1))
    model.weights, model.bias = every[:DIMS], every[DIMS]
    if held:
        s = np.array([model.scores(at, n) for _, at, n in held])
        k = np.array([langs.index(lang) if lang in langs else 0 for lang, *_ in held])

        def loss(t):
            v = s / t
            v = v - v.max(axis=1, keepdims=True)
            return (np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(k)), k]).mean()

        lo, hi = np.log(0.02), np.log(20.0)
        for _ in range(60):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
        model.heat = float(np.exp((lo + hi) / 2))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that are not held out; those with a null id are not learned from."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counted = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = {r[0]: r[1] for r in counted.collect()}
    share = sample // max(1, len(sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, lang, body in rows_of(batches, "id", "lang", "body"):
            n = counts(body.decode("utf-8", "replace"))
            if n is not None:
                at = np.flatnonzero(n)
                yield pa.record_batch([pa.array([str(doc_id)]), pa.array([lang]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([n[at].astype("<u4").tobytes()], pa.binary())], names=["id", "lang", "at", "n"])

    rows = known.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("body"))
    by = Window.partitionBy("lang").orderBy("h", "id", "body")
    low = F.xxhash64("id", F.lit(11)).bitwiseAND(F.lit(2**62 - 1))
    few = F.lit(0)  # hashes up to twice the share of each language; of these, the share is taken
    for lang, n in sizes.items():
        few = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 2.0 * share / n) * 2**62))).otherwise(few)
    rows = rows.withColumn("h", low).where(F.col("h") < few).withColumn("at", F.row_number().over(by)).where(F.col("at") <= share).drop("at", "h")
    got = sorted(rows.mapInArrow(run, "id string, lang string, at binary, n binary").collect())  # at most `sample` rows
    full = [(lang, np.frombuffer(at, "<u2"), np.frombuffer(n, "<u4")) for _, lang, at, n in got]
    del got
    order = np.random.default_rng(1).permutation(len(full))
    return fit([full[i] for i in order])


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score.

    lang_pred is a learned language, or `und` with score 0 where the text is
    null or has no letters, or nothing could be learned.  Only the text is an
    input of a prediction, the whole of it.  Equal texts have equal results;
    the other columns of docs are kept (columns of those three names are
    replaced).
    """
    model = model or train(docs, id_col, text_col, lang_col)
    def predict_all(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score"])

    predict = F.pandas_udf(predict_all, "lang_pred string, score double")

    return _with(docs, held_out(id_col), predict(F.col(text_col)))


def _with(docs: DataFrame, out: Column, said: Column) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    name = fresh(docs, "said")
    df = docs.select(*rest, out.alias("held_out"), said.alias(name))
    return df.select(*rest, "held_out", f"{name}.lang_pred", f"{name}.score")
