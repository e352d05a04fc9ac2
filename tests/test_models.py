"""Models on disk, resampling with holes, and gradients that lack cells."""

import pytest

from wavelake.operators import model


def cells(spark, rows):
    return spark.createDataFrame(rows, "iz bigint, ix bigint, vp double")


def test_saved_model_comes_back(spark, tmp_path):
    made = cells(spark, [(0, 0, 1500.0), (0, 1, 1600.0)])
    model.save_model(made, f"{tmp_path}/m", {"vp": (1400.0, 5000.0)}, {"vp": True})
    got, bounds, flags = model.load_model(spark, f"{tmp_path}/m")
    assert sorted(got.collect()) == sorted(made.collect())
    assert bounds == {"vp": (1400.0, 5000.0)} and flags == {"vp": True}
    with pytest.raises(Exception, match="exist"):
        model.save_model(made, f"{tmp_path}/m", {})


def test_points_without_all_corners_have_no_row(spark):
    rows = [(z, x, float(10 * z + x)) for z in range(4) for x in range(4) if (z, x) != (3, 3)] + [(9, 9, None)]
    got = {(r.iz, r.ix): r.vp for r in model.resampled(cells(spark, rows), ["vp"], (0.5, 0.5), (20, 20)).collect()}
    want = {(i, j): 5.0 * i + 0.5 * j for i in range(7) for j in range(7) if not (i >= 5 and j >= 5)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert model.resampled(cells(spark, []), ["vp"], (0.5, 0.5), (20, 20)).count() == 0


def test_gradient_or_zero_keeps_the_model_s_cells(spark):
    grads = spark.createDataFrame([(0, 0, 2.0), (7, 7, 1.0)], "iz bigint, ix bigint, grad double")
    got = model.gradient_or_zero(cells(spark, [(0, 0, 1.0), (0, 1, 1.0)]), grads)
    assert sorted(got.collect()) == [(0, 0, 2.0), (0, 1, 0.0)]
