"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 10).

A document's features are hashed from its whole text: its distinct words, their beginnings, and shares of
repeated words, capitals and odd signs. All grades share one weight for each hashed feature; ordered thresholds on the sum
part the grades, P(grade <= k) = logistic(threshold_k - score). From them come the expected grade and the tail probability
that selection asks for.

The grades of labelled documents: 0 for low quality, 1 for good prose that is toxic, 2 for good and clean. The model is
fitted in one task on at most ``SAMPLE`` labelled rows, those of smallest hash of doc_id; every document is scored.

Defined cases: a null or empty text has no words and gets the score of that. Labels with a null doc_id, a null
quality, or a null toxic beside a good quality are not used; of repeated labels, one row for each grade at most is
used. Without usable labels every document gets the highest grade. Extra columns pass through ``score``; its result
columns are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed weights; labelled rows used at most; passes over them; grades.
WEIGHTS, SAMPLE, EPOCHS, GRADES = 1 << 18, 20_000, 30, 3
#: How often a feature of the whole text counts.
WHOLE = 4
#: Signs that prose seldom has.
ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
#: Tail probability from which a document is accepted.
LEAST = 0.7
#: Words kept with their weights in a worker at most.
KNOWN = 300_000


def _hash(kind: str, x: str) -> int:
    return zlib.crc32(f"{kind}{x}".encode("utf-8", "surrogatepass")) & (WEIGHTS - 1)


@lru_cache(maxsize=KNOWN // 4)
def word_features(word: str) -> tuple[int, ...]:
    """The features of a word: itself in small letters without marks around it, and its first four characters."""
    bare = word.lower().strip(".,;:!?\"'()[]{}")
    return (_hash("w", bare), _hash("a", bare[:4]))


def text_features(text: str | None) -> tuple[set[str], list[int]]:
    """The distinct words of a text, and features of the whole: its length, and in steps the shares of words that follow
    themselves, are new, are in capitals, and of odd signs and exclamation marks."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    n = max(1, len(words))
    size = int(math.log2(n + 1))
    again = sum(map(str.__eq__, words, words[1:]))
    shares = {"again": again, "capital": sum(map(str.isupper, words)), "odd": len(ODD.findall(text)), "loud": text.count("!!"), "short": sum(len(w) < 2 for w in words)}
    told = [_hash(k, str(min(9, int(10 * x / n)))) for k, x in shares.items()]
    return distinct, [*told, _hash("fresh", f"{int(10 * len(distinct) / n)} {size // 2}"), _hash("long", str(size))]


def scale(n: int) -> float:
    return 1 / math.sqrt(max(n, 1))


def features(text: str | None) -> np.ndarray:
    """All features of a text, one for each distinct word and kind."""
    distinct, more = text_features(text)
    return np.array([*more * WHOLE, *(f for w in distinct for f in word_features(w))], np.int32)


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 4.0, shrink: float = 1e-5, common: float = 0.005) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by adaptive stochastic gradient steps in a fixed order.

    Features that fewer than the share ``common`` of the documents have keep weight zero, as they could only be learned by heart.
    """
    seen_in = np.zeros(WEIGHTS, np.int64)
    for r in rows:
        seen_in[np.unique(r)] += 1
    usable = seen_in >= max(3, common * len(rows))
    scales = np.array([scale(len(r)) for r in rows])
    rows = [np.r_[r[usable[r]], WEIGHTS] for r in rows]  # the last weight stays zero, so no row is empty
    w, squares = np.zeros(WEIGHTS + 1), np.full(WEIGHTS + 1, 1e-2)
    present = np.bincount(grades, minlength=GRADES) + 1.0
    share = np.cumsum(present)[:-1] / present.sum()
    theta = np.log(share / (1 - share))
    rng = np.random.default_rng(0)
    mean_w, mean_theta = np.zeros_like(w), np.zeros_like(theta)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = order[at : at + batch]
            sizes = np.array([len(rows[i]) for i in some])
            idx = np.concatenate([rows[i] for i in some])
            x = np.add.reduceat(w[idx], np.r_[0, np.cumsum(sizes)[:-1]]) * scales[some]
            y = grades[some]
            bounds = np.r_[-np.inf, theta, np.inf]
            above, below = _logistic(bounds[y + 1] - x), _logistic(bounds[y] - x)
            p = np.maximum(above - below, 1e-9)
            hit, where = np.unique(idx, return_inverse=True)
            g = np.bincount(where, np.repeat((above + below - 1) * scales[some], sizes)) - shrink * w[hit] * len(some)
            g[hit == WEIGHTS] = 0
            squares[hit] += g * g
            w[hit] += rate * g / np.sqrt(squares[hit])
            up, down = above * (1 - above) / p, below * (1 - below) / p
            for k in range(GRADES - 1):
                theta[k] += 0.2 * (up[y == k].sum() - down[y == k + 1].sum()) / len(some) / (1 + epoch)
            theta = np.maximum.accumulate(theta + np.arange(GRADES - 1) * 1e-6)
        if epoch >= epochs // 2:  # the mean of the later passes is steadier than the last step
            mean_w += w / (epochs - epochs // 2)
            mean_theta += theta / (epochs - epochs // 2)
    return mean_w[:WEIGHTS].astype("float32"), mean_theta


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.where(np.isinf(x), (x > 0).astype(float), 1 / (1 + np.exp(-np.clip(x, -30, 30))))


def grade_probabilities(score: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(grade) for each score, a column for each grade."""
    low = _logistic(theta[None, :] - score[:, None])
    return np.diff(np.concatenate([np.zeros((len(score), 1)), low, np.ones((len(score), 1))], axis=1), axis=1)


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the usable labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.alias("grade")).where("grade IS NOT NULL").distinct()


def train(docs: DataFrame, rated: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """The model for documents of ``rated`` (doc_id, grade), fitted in one task on at most ``sample`` rows of it.

    The sample is bounded, so its doc_ids are broadcast; its texts become features where they are read.
    """

    @F.pandas_udf("array<int>")
    def hashed(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "grade"], kind="stable")
        w, theta = fit([np.asarray(f, np.int32) for f in rows["f"]], rows["grade"].to_numpy(), epochs)
        return pd.DataFrame({"w": [w.tobytes()], "theta": [theta.tobytes()]})

    chosen = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample))
    used = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "grade", hashed("text").alias("f"))
    got = used.groupBy(F.lit(0).alias("one")).applyInPandas(one, "w binary, theta binary").first()
    if got is None:
        return np.zeros(WEIGHTS, "float32"), np.full(GRADES - 1, -30.0)
    return np.frombuffer(got["w"], "float32"), np.frombuffer(got["theta"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = LEAST) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of the highest grade) and accepted (tail_probability >= least)."""
    w, theta = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    @F.pandas_udf("expected_grade double, tail_probability double")
    def graded(text: pd.Series) -> pd.DataFrame:
        weights = w.value
        known = _known(zlib.crc32(weights.tobytes()))
        scores = np.zeros(len(text))
        for i, t in enumerate(text):
            distinct, more = text_features(t)
            total = WHOLE * float(weights[more].sum())
            for x in distinct:
                v = known.get(x)
                if v is None:
                    v = float(weights[list(word_features.__wrapped__(x))].sum())
                    if len(known) < KNOWN:
                        known[x] = v
                total += v
            scores[i] = total * scale(2 * len(distinct) + WHOLE * len(more))
        p = grade_probabilities(scores, theta)
        return pd.DataFrame({"expected_grade": p @ np.arange(GRADES), "tail_probability": p[:, -1]})

    scored = docs.withColumn("_dn_grade", graded("text"))
    out = scored.withColumns({"expected_grade": F.col("_dn_grade.expected_grade"), "tail_probability": F.col("_dn_grade.tail_probability")})
    return out.withColumn("accepted", F.col("tail_probability") >= least).drop("_dn_grade")


@lru_cache(maxsize=1)
def _known(model: int) -> dict[str, float]:
    """A worker's words and their weights under one model."""
    return {}


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    return score(docs, train(docs, ratings(labels), sample), least)
