"""Operators 3 and 10 against exhaustive versions on small inputs."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftnet.llm import quality, sharding


def probabilities(x, theta):
    """Of each grade, by the formula: differences of logistic functions of the thresholds less the score."""
    upto = [0.0, *[1 / (1 + math.exp(x - t)) for t in theta], 1.0]
    return [b - a for a, b in zip(upto, upto[1:], strict=False)]


def likelihood(parameters, rows, grades, ids):
    """The mean negative log likelihood of ordered grades; the parameters are a weight for each of ids, then the thresholds."""
    w = dict(zip(ids, parameters, strict=False))
    return -sum(math.log(max(probabilities(sum(w.get(f, 0.0) for f in r.tolist()) * quality.scale(len(r)), parameters[len(ids) :])[y], 1e-12)) for r, y in zip(rows, grades, strict=True)) / len(rows)


def slopes(f, at, step=1e-5):
    return np.array([(f(at + step * e) - f(at - step * e)) / (2 * step) for e in np.eye(len(at))])


def graded_rows(n, seed):
    rng = np.random.default_rng(seed)
    ids, weights, theta = [11, 22, 33], np.array([4.0, -3.0, 1.5]), np.array([-1.0, 1.2])
    rows, grades = [], []
    for _ in range(n):
        r = np.array([i for i in ids if rng.random() < 0.5], np.int32)
        x = sum(weights[ids.index(f)] for f in r.tolist()) * quality.scale(len(r))
        rows.append(r)
        grades.append(int(rng.choice(3, p=probabilities(x, theta))))
    return ids, rows, np.array(grades)


def test_fit_nears_the_greatest_likelihood():
    """Descent along finite differences finds the optimum; the fit gains nearly all that this gains over no weights, and tells the same probabilities."""
    ids, rows, grades = graded_rows(500, 3)
    f = lambda p: likelihood(p, rows, grades, ids)
    best, rate = np.array([0.0, 0, 0, -1, 1]), 4.0
    for _ in range(60):
        g = slopes(f, best)
        while f(best - rate * g) > f(best) and rate > 1e-3:
            rate /= 2
        best, rate = best - rate * g, rate * 1.5
    assert abs(slopes(f, best)).max() < 5e-3
    w, theta = quality.fit(rows, grades, epochs=30, rate=1.0)
    found = np.array([*w[ids], *theta], float)
    null = f(np.array([0.0, 0, 0, *(np.log(x / (1 - x)) for x in np.cumsum(np.bincount(grades))[:-1] / len(grades))]))
    assert null - f(found) > 0.98 * (null - f(best))
    assert np.count_nonzero(w) == 3 and (np.sign(w[ids]) == np.sign(best[:3])).all()
    for r in product((0, 1), repeat=3):
        x = lambda p: float(np.dot(p[:3], r)) * quality.scale(sum(r))  # noqa: B023, E731
        assert np.allclose(probabilities(x(found), found[3:]), probabilities(x(best), best[3:]), atol=0.12)


def test_grade_probabilities_by_the_formula():
    rng = np.random.default_rng(1)
    scores, theta = rng.normal(size=50) * 3, np.array([-0.7, 1.9])
    assert np.allclose(quality.grade_probabilities(scores, theta), [probabilities(x, theta) for x in scores])


def test_query_results_by_a_plain_loop(spark):
    """Every document's expected grade and tail probability, from the model's weights, feature by feature."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w, theta = quality.train(docs, quality.ratings(labels))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for d, text in texts:
        f = quality.features(text)
        p = probabilities(float(w[f].astype(float).sum()) * quality.scale(len(f)), theta)
        assert got[d].tail_probability == pytest.approx(p[2], abs=1e-5) and got[d].expected_grade == pytest.approx(p[1] + 2 * p[2], abs=1e-5)
        assert got[d].accepted == (got[d].tail_probability >= quality.LEAST)


def test_few_toxic_documents_pass(spark):
    sf = "/root/testdata/sf0.1"
    docs, rated = spark.read.parquet(f"{sf}/documents.parquet"), quality.ratings(spark.read.parquet(f"{sf}/labels.parquet"))
    held = rated.where("doc_id % 5 = 1")
    scored = quality.score(docs.join(held, "doc_id"), quality.train(docs, rated.where("doc_id % 5 <> 1")))
    a = {r.grade: r.a for r in scored.groupBy("grade").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()}
    assert a[2] > 0.98 and a[0] < 0.03 and a[1] < 0.3, a


def least_spread(sizes, k):
    """Over all ways to deal the sizes."""
    return min(max(s) - min(s) for deal in product(range(k), repeat=len(sizes)) for s in [[sum(x for x, d in zip(sizes, deal, strict=True) if d == j) for j in range(k)]])


def spread(sizes, k):
    sums = [0] * k
    for size, places in zip(sizes, sharding.karmarkar_karp([[s] + [0] * (k - 1) for s in sizes]), strict=True):
        sums[places[0]] += size
    return max(sums) - min(sums)


def test_differencing_against_the_best_deal():
    """Differencing is exact for up to four sizes in two shards; beyond, on average it stays near the best, and far nearer than a greedy deal."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4):
        for _ in range(60):
            sizes = rng.integers(1, 60, n).tolist()
            assert spread(sizes, 2) == least_spread(sizes, 2), sizes
    over, greedy = [], []
    for _ in range(60):
        sizes = rng.integers(1, 200, 9).tolist()
        best = least_spread(sizes, 2)
        over.append(spread(sizes, 2) - best)
        sums = [0, 0]
        for s in sorted(sizes, reverse=True):
            sums[sums.index(min(sums))] += s
        greedy.append(abs(sums[0] - sums[1]) - best)
    assert np.mean(over) < 15 and np.mean(over) < np.mean(greedy)
    for k in (3, 4):
        sizes = rng.integers(50, 100, 7).tolist()
        assert least_spread(sizes, k) <= spread(sizes, k) <= max(sizes)
