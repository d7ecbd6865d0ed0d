"""Quality classifier by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled web text train a small
network by the non-negative unbiased risk: pi * E_p[l(g)] + max(0,
E_u[l(-g)] - pi * E_p[l(-g)]). The class prior pi is estimated from positives and
unlabelled texts alone: a linear model tells the two apart, and among the scores
above a bound the unlabelled share divided by the positives' share comes down to
pi where the bound leaves out all that is no positive. The network starts from a
bounded sample; then the unlabelled risk and its gradient are summed over all
documents by Spark, step by step, as are the features' mean and scale.
Scores come from the text alone: shares of character classes, word shapes and
repetition, measured over the whole text.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import chunks, hashed_words, shingles, small, table, text_or_empty

#: Bounds on the labelled positives that training sees, and on the unlabelled rows of
#: its start (documented parameters of :func:`fit`).
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 24_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 60, 512, 0.01, 7
#: Steps over all documents after the start, and their rate.
STEPS, STEP_RATE = 8, 0.002
#: Least scale of a feature: one that hardly varies in training counts for little.
LEAST_SCALE = 1e-4
#: Confidence and slack of the prior's estimate.
DELTA, SLACK = 0.1, 0.01
SPLIT = 1 << 30

_CLASSES = [
    lambda c: 97 <= c <= 122,
    lambda c: 65 <= c <= 90,
    lambda c: 48 <= c <= 57,
    lambda c: c == 32,
    lambda c: c == 10,
    lambda c: c in b",;:",
    lambda c: c == 46,
    lambda c: c == 33,
    lambda c: c == 63,
    lambda c: c in b"#$%&*@^~=+_\\/",
    lambda c: c == 124,
    lambda c: c in b"<>{}[]()",
    lambda c: c in b"'\"`-",
    lambda c: c >= 128,
]
N_FEATURES = len(_CLASSES) + 14


def features(texts: list[str]) -> np.ndarray:
    """One row of numbers per text; an empty text has all zeros."""
    flags = np.array([[f(c) for f in _CLASSES] for c in range(256)], dtype=np.float64)
    out = np.zeros((len(texts), N_FEATURES))
    for lo, hi in chunks([len(t or "") + 1 for t in texts]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        words, owner = hashed_words(raw)
        runs, run_owner = shingles(words, owner, 3)
        at = np.searchsorted(owner, np.arange(hi - lo + 1))
        rat = np.searchsorted(run_owner, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            data, n = raw[i], at[i + 1] - at[i]
            if not data:
                continue
            counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
            share = counts @ flags / len(data)
            row = out[lo + i]
            row[: len(_CLASSES)] = share
            k = len(_CLASSES)
            letters = share[0] + share[1]
            row[k] = np.log1p(len(data))
            row[k + 1] = np.log1p(n)
            row[k + 2] = len(data) / max(1, n) / 10
            row[k + 3] = share[1] / max(letters, 1e-9)
            row[k + 4] = np.log1p(1000 * share[9])
            row[k + 5] = np.log1p(1000 * share[10])
            row[k + 6] = np.log1p(1000 * share[7])
            row[k + 7] = np.log1p(1000 * share[6])
            p = counts[counts > 0] / len(data)
            row[k + 8] = -(p * np.log(p)).sum()
            if n:
                _, c = np.unique(words[at[i] : at[i + 1]], return_counts=True)
                row[k + 9] = len(c) / n
                row[k + 10] = c.max() / n
            m = rat[i + 1] - rat[i]
            if m:
                row[k + 11] = len(np.unique(runs[rat[i] : rat[i + 1]])) / m
                row[k + 12] = 1.0
            lines = data.split(b"\n")
            row[k + 13] = len(set(lines)) / len(lines)
    return out


def _forward(model, x):
    h = np.tanh((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"])
    return h, h @ model["w2"] + model["b2"]


WEIGHTS = ("w1", "b1", "w2", "b2")


def _sig(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _parts(model, x, sign: float):
    """Sums over the rows of ``x`` of the logistic loss l(sign * g) and of its
    gradients by the weights."""
    h, g = _forward(model, x)
    dg = sign * (_sig(sign * g) - 1)
    back = dg[:, None] * model["w2"] * (1 - h**2)
    return np.logaddexp(0, -sign * g).sum(), {"w1": ((x - model["mean"]) / model["scale"]).T @ back, "b1": back.sum(0), "w2": h.T @ dg, "b2": dg.sum()}


def risk(model, positive, unlabelled, prior: float):
    """The non-negative risk and the gradient to walk down, from (loss sum, gradient
    sums, rows) of l(g) and l(-g) over positives and of l(-g) over unlabelled rows."""
    (good, grad_good, n), (bad, grad_bad, _), (free, grad_free, m) = *positive, unlabelled
    negative = free / m - prior * bad / n
    value = prior * good / n + max(0.0, negative)
    if negative >= 0:
        return value, {k: prior * (grad_good[k] - grad_bad[k]) / n + grad_free[k] / m for k in WEIGHTS}
    # the estimate of the negative risk is below zero: walk it back up
    return value, {k: prior * grad_bad[k] / n - grad_free[k] / m for k in WEIGHTS}


def _positive_parts(model, x):
    return (*_parts(model, x, 1.0), len(x)), (*_parts(model, x, -1.0), len(x))


class Adam:
    """Adam steps with a little weight decay."""

    def __init__(self, model):
        self.moments, self.step = {k: (np.zeros_like(model[k]), np.zeros_like(model[k])) for k in WEIGHTS}, 0

    def walk(self, model, grads, rate: float):
        self.step += 1
        for k in WEIGHTS:
            g = grads[k] + 1e-4 * model[k]
            a, b = self.moments[k]
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            self.moments[k] = a, b
            model[k] = model[k] - rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean=None, scale=None) -> dict:
    """A one-hidden-layer network that minimises the non-negative PU risk."""
    rng = np.random.default_rng(SEED)
    d = unlabelled.shape[1]
    m = {"mean": unlabelled.mean(0) if mean is None else mean, "scale": unlabelled.std(0) + 1e-6 if scale is None else scale,
         "w1": rng.normal(0, d**-0.5, (d, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": 0.0}
    adam = Adam(m)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(unlabelled))
        for lo in range(0, len(order), BATCH):
            xu = unlabelled[order[lo : lo + BATCH]]
            xp = positive[rng.integers(0, len(positive), min(BATCH, len(positive)))]
            _, grads = risk(m, _positive_parts(m, xp), (*_parts(m, xu, -1.0), len(xu)), prior)
            adam.walk(m, grads, RATE * (1 - epoch / EPOCHS))
    return m


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, mean, scale) -> float:
    """The share of positives among unlabelled rows.

    A logistic model of both kinds is fitted on one half; on the other, q(c) is the
    share of a kind that scores c or more. The bound c is chosen with the least
    upper estimate of q_u(c) / q_p(c), which is then the prior."""
    x = [np.hstack([(a - mean) / scale, np.ones((len(a), 1))]) for a in (positive, unlabelled)]
    (p, q), (fp, fq) = [(a[::2], a[1::2] if len(a) > 1 else a) for a in x]
    w = np.zeros(p.shape[1])
    for _ in range(25):  # Newton steps, each kind with half the weight
        hess, grad = 1e-3 * np.eye(len(w)), 1e-3 * w
        for a, target in ((p, 1.0), (fp, 0.0)):
            s = _sig(a @ w)
            grad = grad + a.T @ (s - target) / (2 * len(a))
            hess = hess + (a * (s * (1 - s))[:, None]).T @ a / (2 * len(a))
        w = w - np.linalg.solve(hess, grad)
    sp, su = np.sort(q @ w), np.sort(fq @ w)
    bounds = np.unique(sp)
    qp = 1 - np.searchsorted(sp, bounds) / len(sp)
    qu = 1 - np.searchsorted(su, bounds) / len(su)
    slack = (1 + SLACK) * (np.sqrt(np.log(4 / DELTA) / (2 * len(su))) + np.sqrt(np.log(4 / DELTA) / (2 * len(sp)))) / qp
    best = np.argmin(qu / qp + slack)
    return float(min(max(qu[best] / qp[best], 0.02), 0.98))


def predict(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(_forward(model, features(texts))[1], -40, 40)))


def held_out(key):
    """The fold that no label is learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _bounded(df: DataFrame, key, most: int) -> DataFrame:
    """About ``most`` rows at most, by a hash of ``key``; the same ones on every run."""
    n = df.count()
    return df.filter(F.pmod(F.xxhash64(*key), F.lit(SPLIT)) < int(SPLIT * min(1.0, most / max(1, n))))


def _matrix(rows: DataFrame) -> np.ndarray:
    x = np.array([np.frombuffer(f, dtype=np.float64) for f in rows.select("f").toPandas()["f"]]).reshape(-1, N_FEATURES)
    return x[np.lexsort(tuple(x.T))]  # the order of arrival differs between runs


def _summed(rows: DataFrame, what, width: int) -> np.ndarray:
    """The sum over all rows of ``what``(matrix of features), a vector of ``width``:
    a partial sum per Arrow batch, added by position."""
    def partial(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"i": np.arange(width), "v": what(np.frombuffer(b"".join(b["f"]), dtype=np.float64).reshape(-1, N_FEATURES))})

    total = np.zeros(width)
    for i, v in rows.select("f").mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
        total[i] = v
    return total


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, steps: int = STEPS) -> dict | None:
    """Train on rows outside the held-out fold.

    Positives are labelled quality 1, about ``max_positive`` of them at most; the
    unlabelled rows are all of ``docs``, whatever their labels. Their mean and scale,
    and in ``steps`` steps their risk, are summed over all of them; the first
    weights and the prior come from about ``max_unlabelled``. Null texts count as
    empty, repeated rows each; rows without an id are unlabelled. None if there is
    no positive or no document.
    """
    known = labels.filter((F.col("quality") == 1) & ~held_out("doc_id")).select(F.col("doc_id").alias("known")).distinct()
    known = _bounded(known, ["known"], max_positive)
    pool = docs.filter(~held_out("doc_id")).select("doc_id", text_or_empty("text").alias("text"))

    def extract(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "f": [f.tobytes() for f in features(b["text"].tolist())]})

    table_ = materialize(pool.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), "text").mapInPandas(extract, "doc_id long, h long, f binary"), "quality-features")
    # one row per id and text, so that repeats do not outgrow the bound
    positive = _matrix(table_.join(small(materialize(known, "quality-positives"), 16), F.col("doc_id") == F.col("known"), "left_semi").groupBy("doc_id").agg(F.min_by("f", "h").alias("f")))
    n = table_.count()
    if not len(positive) or not n:
        return None
    start = _matrix(_bounded(table_, ["h"], max_unlabelled).groupBy("h").agg(F.first("f").alias("f")))
    if not len(start):
        return None
    near = start.mean(0)  # sums of squares are taken from a point nearby, so little cancels
    sums = _summed(table_, lambda x: np.concatenate([(x - near).sum(0), ((x - near) ** 2).sum(0)]), 2 * N_FEATURES) / n
    # rounded, as the order of summands differs between runs
    mean = np.round(near + sums[:N_FEATURES], 9)
    scale = np.maximum(np.round(np.sqrt(np.maximum(sums[N_FEATURES:] - sums[:N_FEATURES] ** 2, 0)), 6), LEAST_SCALE)
    prior = estimate_prior(positive, start, mean, scale)
    model = train_nnpu(positive, start, prior, mean, scale) | {"prior": prior}
    shapes = {k: np.shape(model[k]) for k in WEIGHTS}
    sizes = [int(np.prod(shapes[k])) for k in WEIGHTS]
    adam = Adam(model)
    for step in range(steps):
        now = dict(model)

        def parts(x, now=now):
            loss, grads = _parts(now, x, -1.0)
            return np.concatenate([[loss], *[np.ravel(grads[k]) for k in WEIGHTS]])

        got = _summed(table_, parts, 1 + sum(sizes))
        free = {k: a.reshape(shapes[k]) for k, a in zip(WEIGHTS, np.split(got[1:], np.cumsum(sizes)[:-1]))}
        _, grads = risk(model, _positive_parts(model, positive), (got[0], free, n), prior)
        adam.walk(model, grads, STEP_RATE * (1 - step / steps))
    return model


def score_quality(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) to ``docs``; a column of that name is replaced.

    Null text scores as the empty text. Equal texts score alike; the id, source,
    language and labels play no part. Without a model every score is 0.5.
    """
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(predict(model, t.tolist()))

    return docs.withColumn("score", score(text_or_empty(F.col(text))))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The score of every row of ``documents``; see :func:`score_quality` for null,
    empty and repeated texts. Without labels every score is 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
