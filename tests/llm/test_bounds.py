"""Worker caches are bounded by bytes, and the fits of op8 end at their fixed points."""

import random

import numpy as np
import pytest

from wavelake.llm import pieces, token_counts, toxicity


def test_caches_keep_no_long_pre_tokens(spark):
    vocabulary, long = pieces.load_vocabulary(pieces.default_model()), b"x" * 5000
    cache = pieces.Cache()
    first = cache.coded(vocabulary, [[b"plain", long], [long]])
    assert set(cache) == {b"plain"} and cache.coded(vocabulary, [[b"plain", long], [long]]) == first
    with open(pieces.default_model(), "rb") as f:
        lengths = token_counts.Lengths(f.read(), {})
    n = lengths[long]
    assert n == len(lengths.library.encode(long.decode())) and long not in lengths and lengths[b"plain"] and b"plain" in lengths
    docs = spark.createDataFrame([(1, "word " + "y" * 100_000), (2, ""), (3, None), (1, "word")], "doc_id bigint, text string")
    rows = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert rows == sorted((i, len(t), len(lengths.library.encode(t))) for i, t in [(1, "word " + "y" * 100_000), (2, ""), (3, ""), (1, "word")])
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def votes_drawn(rows=600):
    rng = random.Random(5)
    n = toxicity.VOTERS + len(toxicity.PATTERNS)
    truth = np.array([rng.random() < 0.2 for _ in range(rows)])
    return truth, np.array([[float(rng.random() < (0.3 if y else 0.04)) for _ in range(n)] for y in truth]), np.ones(rows)


def test_label_model_ends_at_its_fixed_point(monkeypatch):
    truth, votes, weight = votes_drawn()
    got, model = toxicity.label_model(votes, weight, 0.2, labels=truth.astype(float))
    p, share, prior = model["fires"], model["share"], model["prior"]
    said = np.log(toxicity.LABEL_ACCURACY / (1 - toxicity.LABEL_ACCURACY)) * (2 * truth - 1)
    for y, belief in ((1, got), (0, 1 - got)):
        assert np.allclose(p[y], (belief @ votes + 0.5) / (belief.sum() + 1), atol=1e-5)
    odds = said + np.log(prior / (1 - prior)) + (votes * np.log(p[1] / p[0]) + (1 - votes) * np.log((1 - p[1]) / (1 - p[0]))) @ share
    assert np.allclose(got, 1 / (1 + np.exp(-odds)), atol=1e-5)
    monkeypatch.setattr(toxicity, "MOST_ROUNDS", 3)
    with pytest.raises(ArithmeticError):
        toxicity.label_model(votes, weight, 0.2)


def test_classifier_ends_where_the_gradient_is_zero():
    """Also where whole Newton steps would overshoot: separable rows of very uneven weights."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 8)) * 40.0
    weight, y = 10.0 ** rng.integers(0, 5, 300), (x[:, 0] > 0).astype(float)
    w = toxicity.linear_classifier(x, y, weight, ridge=0.01)
    whole = np.hstack([x, np.ones((300, 1))])
    p = 1 / (1 + np.exp(-whole @ w))
    assert np.abs(whole.T @ (weight * (p - y)) + 0.01 * w).max() < 1e-3
