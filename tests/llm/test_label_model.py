"""op8: the label model and the classifier against plain versions, and tables that leave nothing to learn."""

import math
import random

import numpy as np

from wavelake.llm import toxicity


def plain_label_model(votes, weight, rate, rounds):
    belief = [min(0.95, max(0.05, v[toxicity.VOTERS])) for v in votes]
    n, total = len(votes[0]), sum(weight)
    for _ in range(rounds):
        p = {}
        for y in (0, 1):
            mass = [w * (b if y else 1 - b) for w, b in zip(weight, belief)]
            p[y] = [min(1 - 1e-4, max(1e-4, (sum(m * v[j] for m, v in zip(mass, votes)) + 0.5) / (sum(mass) + 1))) for j in range(n)]
        prior = min(1 - 1e-3, max(1e-3, (sum(w * b for w, b in zip(weight, belief)) + rate * 10) / (total + 10)))
        cov = [[sum(w * sum(q * (v[j] - p[y][j]) * (v[k] - p[y][k]) for y, q in ((1, b), (0, 1 - b))) for w, b, v in zip(weight, belief, votes)) / total for k in range(n)] for j in range(n)]
        corr = [[abs(cov[j][k]) / math.sqrt(max(cov[j][j], 1e-12) * max(cov[k][k], 1e-12)) for k in range(n)] for j in range(n)]
        share = [1 / max(1.0, sum(c for c in row if c > 0.1)) for row in corr]
        belief = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(s * (math.log(p[1][j] / p[0][j]) if v[j] else math.log((1 - p[1][j]) / (1 - p[0][j]))) for j, s in enumerate(share))
            belief.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
    return belief


def drawn(rows=400):
    """Votes of independent voters of known accuracy, and the hidden labels."""
    rng = random.Random(8)
    n = toxicity.VOTERS + len(toxicity.PATTERNS)
    truth = [rng.random() < 0.3 for _ in range(rows)]
    votes = [[float(rng.random() < (0.6 if y else 0.05)) for _ in range(n)] for y in truth]
    return truth, votes, [float(rng.randrange(1, 4)) for _ in range(rows)]


def test_label_model():
    truth, votes, weight = drawn(120)
    got, model = toxicity.label_model(np.array(votes), np.array(weight), 0.3, 4)
    assert np.allclose(got, plain_label_model(votes, weight, 0.3, 4), atol=1e-9)
    truth, votes, weight = drawn()
    got, model = toxicity.label_model(np.array(votes), np.array(weight), 0.3)
    assert np.mean((got > 0.5) == truth) > 0.99
    assert abs(model["fires"][1].mean() - 0.6) < 0.05 and abs(model["fires"][0].mean() - 0.05) < 0.03


def test_copies_of_a_voter_count_as_one():
    """Ten copies of one voter are no more evidence than the voter alone."""
    _, votes, weight = drawn()
    votes = np.array(votes)
    votes[:, 1:11] = votes[:, :1]
    _, model = toxicity.label_model(votes, np.array(weight), 0.3)
    assert model["share"][:11].sum() < 1.5 and np.median(model["share"][11:]) > 5 * model["share"][0]


def test_linear_classifier():
    rng = np.random.default_rng(4)
    x, weight = rng.integers(0, 2, (200, 5)).astype(float), rng.integers(1, 4, 200).astype(float)
    y = 1 / (1 + np.exp(-(x @ [2, -1, 0.5, 0, 1] - 1)))
    got = toxicity.linear_classifier(x, y, weight)
    loss = lambda w: weight @ (np.log1p(np.exp(np.hstack([x, np.ones((200, 1))]) @ w)) - y * (np.hstack([x, np.ones((200, 1))]) @ w)) + 0.15 * w @ w
    assert all(loss(got) <= loss(got + step) for step in rng.normal(0, 0.01, (200, 6)))


def test_voters_see_different_words():
    for word in ("stupidity", "abcd", "abc", "idiotisch"):
        assert len({toxicity.voter_of(e) for e in toxicity.entries_of(word)}) == 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(i, None if i == 3 else f"t{'abcdefgh'[i]}{'abcdefgh'[i]}oxic") for i in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == 8 and len({r.score for r in rows}) == 1
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
