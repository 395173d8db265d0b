"""Quality classifier without labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a document.  Expectation
maximisation over the counts of all vote patterns (all documents, but at most
3 ** labellers rows) estimates how often each labeller is right, and so the
posterior of a document being good.  The posteriors of a bounded sample train
a logistic scorer on hashed words and shape features, which scores every
document.
"""


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_sample, doc_key, rows_of, slice_hashes, spool, word_spans

DIMS = 1 << 16
#: Documents whose posteriors train the scorer at most.
SAMPLE = 4000
KEEP = 0.5
#: Abuse that a labeller looks for (fixed values).
TOXIC = [b"clown", b"disgusting", b"idiot", b"loser", b"moron", b"pathetic", b"scum", b"stupid", b"trash", b"worthless"]
LABELLERS = ["length", "symbols", "lines", "repeats", "word_length", "case", "abuse", "marked_words", "repeated_windows"]
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>{}~^=_\\!")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def votes(text: bytes | None) -> tuple[list[int], np.ndarray]:
    """The labellers' votes (1 good, -1 bad, 0 none) and the hashes of the text's words."""
    data = np.frombuffer(text or b"", np.uint8)
    start, end = word_spans(data)
    n = len(start)
    if not n:
        return [-1, *[0] * (len(LABELLERS) - 1)], np.zeros(0, np.uint64)
    h = np.concatenate([slice_hashes(data[a:b], start[i:j] - a, end[i:j] - a) for i, j, a, b in _cuts(start, end)])
    chars = int((end - start).sum())
    marks = int(_MARKS[data].sum()) / chars
    before = np.concatenate([[0], np.cumsum(_MARKS[data])])
    marked = float((before[end] > before[start]).mean())
    upper = int(_UPPER[data].sum()) / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    variety = _distinct(h) / n
    three = h[2:] + U64(3) * h[1:-1] + U64(5) * h[:-2]  # wraps
    fresh = _distinct(three) / len(three) if len(three) else 1.0
    mean = chars / n
    low = text.lower()
    abuse = sum(low.count(w) for w in TOXIC)
    rule = lambda bad, good: -1 if bad else 1 if good else 0
    return [
        rule(n < 30, n >= 80), rule(marks > 0.10, marks < 0.02), rule(again > 0.3, again < 0.1 and len(lines) > 1), rule(variety < 0.4, variety > 0.55),
        rule(mean < 2.5 or mean > 12, 3.5 < mean < 10), rule(upper > 0.4, upper < 0.15), rule(abuse >= 3 and abuse > n / 400, False),
        rule(marked > 0.25, marked < 0.10), rule(fresh < 0.7, fresh > 0.9),
    ], h


def _distinct(h: np.ndarray, block: int = 400) -> int:
    """Distinct values within each `block` consecutive ones, summed: a measure that long texts do not lower."""
    at = np.arange(len(h)) // block
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    return 1 + int(((h[1:] != h[:-1]) | (at[1:] != at[:-1])).sum())


def _cuts(start: np.ndarray, end: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of words and of their bytes, about `size` bytes each."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + size, "right")))
        yield i, j, int(start[i]), int(end[j - 1])
        i = j


def fit_accuracies(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(prior of good, accuracy[labeller, vote of -1 or 1 | class]) by EM on vote patterns and their counts."""
    k = patterns.shape[1]
    good = patterns.sum(axis=1) > 0  # start from the majority
    post = np.where(good, 0.9, 0.1)
    for _ in range(rounds):
        w = np.stack([n * (1 - post), n * post])
        prior = (w[1].sum() + 1) / (n.sum() + 2)
        p = np.empty((2, k, 3))
        for v in (-1, 0, 1):
            p[:, :, v + 1] = (w @ (patterns == v) + 1) / (w.sum(axis=1)[:, None] + 3)
        # a labeller is no worse than chance: else classes could swap
        flip = p[1, :, 2] * p[0, :, 0] < p[0, :, 2] * p[1, :, 0]
        p[:, flip, :] = p[:, flip, :].mean(axis=0, keepdims=True)
        new = posterior(patterns, prior, p)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return prior, p


def posterior(patterns: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    k = np.arange(patterns.shape[1])
    log = [np.log(q) + np.log(p[c][k, patterns + 1]).sum(axis=1) for c, q in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def features(vote: list[int], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words by their share of the text, and the votes."""
    at, n = np.unique((h >> U64(48)).astype(np.int64), return_counts=True)
    x = np.sqrt(n / max(1, n.sum()))
    shape = np.array([DIMS + 3 * i + v + 1 for i, v in enumerate(vote)] + [DIMS + 3 * len(vote)])
    return np.concatenate([at, shape]), np.concatenate([x, np.ones(len(shape))])


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 5, rate: float = 0.3, l2: float = 1e-5) -> np.ndarray:
    """Weights by AdaGrad on soft labels."""
    w, q = np.zeros(DIMS + 3 * len(LABELLERS) + 1), np.full(DIMS + 3 * len(LABELLERS) + 1, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            g = x * (1 / (1 + np.exp(-np.clip(x @ w[at], -30, 30))) - y) + l2 * w[at]
            q[at] += g * g
            w[at] -= rate * g / np.sqrt(q[at])
    return w


def classify(docs: DataFrame, keep: float = KEEP, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the scorer, 0 to 1) and kept (score >= keep) for each row of docs.

    Null, empty and blank texts get only the vote against short texts and are
    scored like others.  Equal texts have equal results; rows and null ids are
    kept, other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_key(id_col).alias("doc_key"), F.col(text_col).cast("binary").alias("body"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in batch.column(batch.schema.get_field_index("body")).to_pylist():
                v, _ = votes(body)
                out.append(sum((x + 1) * 3**i for i, x in enumerate(v)))
            yield pa.record_batch([pa.array(out, pa.int32())], names=["pattern"])

    counts = spool(rows.mapInArrow(vote, "pattern int").groupBy("pattern").count(), "votes").collect()  # at most 3 ** labellers rows
    if not counts:
        return docs.sparkSession.createDataFrame([], "doc_id long, posterior double, score double, kept boolean")
    patterns = np.array([[r[0] // 3**i % 3 - 1 for i in range(len(LABELLERS))] for r in counts])
    total = sum(r[1] for r in counts)
    prior, p = fit_accuracies(patterns, np.array([r[1] for r in counts], float))

    picked = bounded_sample(rows, F.xxhash64("doc_key", "body", F.lit(5)), sample, total)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, body in rows_of(batches, "doc_key", "body"):
            v, h = votes(body)
            at, x = features(v, h)
            y = posterior(np.array([v]), prior, p)[0]
            yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([x.astype("<f4").tobytes()], pa.binary()), pa.array([float(y)])], names=["doc_key", "at", "x", "y"])

    got = sorted(picked.mapInArrow(vectors, "doc_key long, at binary, x binary, y double").collect())
    w = train_scorer([(np.frombuffer(r[1], "<u4").astype(np.int64), np.frombuffer(r[2], "<f4").astype(float), r[3]) for r in got]).astype(np.float32)

    def score(body: pd.Series) -> pd.DataFrame:
        out = []
        for b in body:
            v, h = votes(b)
            at, x = features(v, h)
            out.append((float(posterior(np.array([v]), prior, p)[0]), float(1 / (1 + np.exp(-np.clip(x @ w[at], -30, 30))))))
        return pd.DataFrame(out, columns=["posterior", "score"])

    said = F.pandas_udf(score, "posterior double, score double")(F.col("body"))
    out = rows.select("doc_id", said.alias("said")).select("doc_id", "said.posterior", "said.score")
    return out.withColumn("kept", F.col("score") >= keep)
