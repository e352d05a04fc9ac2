"""The low-pass: its gain, its adjoint, nulls and lengths."""

import math

import numpy as np
import pytest

from wavelake.functions import spectrum


def test_gain():
    g = spectrum.butterworth_gain(1000, 6, 100, 3)
    assert g[0] == 1 and math.isclose(g[60], 0.5, abs_tol=1e-9) and g[-1] < 1e-9 and (np.diff(g) <= 0).all()
    with pytest.raises(ValueError):
        spectrum.butterworth_gain(100, 60, 100, 3)


def test_low_pass(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 90))
    t = np.arange(400) / 100
    rows = [(1, x.tolist()), (2, y.tolist()), (3, None), (4, []), (5, np.sin(2 * math.pi * t).tolist()), (6, np.sin(2 * math.pi * 30 * t).tolist())]
    made = {r.k: r.amp for r in spectrum.low_pass(spark.createDataFrame(rows, "k int, amp array<double>"), 6, 100).collect()}
    assert made[3] is None and made[4] == [] and len(made[1]) == 90
    back = {r.k: r.amp for r in spectrum.low_pass_adjoint(spark.createDataFrame(rows, "k int, amp array<double>"), 6, 100).collect()}
    assert math.isclose(np.dot(made[1], y), np.dot(x, back[2]), rel_tol=1e-9)
    middle = slice(100, 300)
    assert np.allclose(np.array(made[5])[middle], np.sin(2 * math.pi * t)[middle], atol=0.02) and np.abs(np.array(made[6])[middle]).max() < 0.01
