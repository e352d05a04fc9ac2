"""The registered soft-DTW and Sinkhorn misfits count every sample of each trace."""

import numpy as np
import pytest

from wavelake.operators import misfit
from wavelake.queries import QUERIES


@pytest.mark.parametrize("name", ["misfit_soft_dtw", "misfit_soft_dtw_correlation", "misfit_sinkhorn"])
def test_every_sample_counts(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).tolist(), i // 2) for i in range(4)]
    moved = [(i, [x + 3 * (k % 2) * (i % 2) for k, x in enumerate(v)], s) for i, v, s in rows]  # odd samples of the synthetic traces
    made = []
    for k, own in enumerate((rows, moved)):
        spark.createDataFrame(own, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        made.append({r.shot: r.misfit for r in QUERIES[name](spark, f"{tmp_path}/{k}").collect()})
    assert made[0].keys() == made[1].keys() and all(made[0][s] != made[1][s] for s in made[0])
    if name == "misfit_soft_dtw":
        value = lambda a, b, gamma: misfit.soft_dtw_value(a[None], b[None], gamma)[0]
        x, y = (np.array(rows[i][1], np.float32).astype(float) for i in (0, 1))
        assert abs(made[0][0] - (value(x, y, 1.0) - (value(x, x, 1.0) + value(y, y, 1.0)) / 2)) < 1e-5
