"""One id with several unlike texts, in the near-duplicate stage."""

import numpy as np

from wavelake.llm import simhash


def test_groups_of_one_id_stay_apart(spark):
    rng = np.random.default_rng(5)
    a, b, c = (" ".join(f"{x}{i}" for i in rng.integers(0, 1000, 60)) for x in "abc")
    near = lambda t, w: " ".join([*t.split()[:-1], w])
    rows = [(5, a), (5, b), (5, c), (9, near(b, "x")), (8, near(a, "y")), (4, near(c, "z")), (5, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.one_of_each_group(docs).collect()))
    assert kept == sorted([(0, a), (5, a), (5, b), (4, near(c, "z"))])


def test_shuffled_joins(spark):
    """With joins that shuffle, the same rows stay, and only rows that may go are shuffled for it."""
    rng = np.random.default_rng(8)
    plain = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 40)) for _ in range(60)]
    rows = [*enumerate(plain), *((100 + k, f"{t} more") for k, t in enumerate(plain[:10])), *((k, plain[k]) for k in range(5)), (None, plain[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    name, want = "spark.sql.autoBroadcastJoinThreshold", sorted([*enumerate(plain), (-1, plain[0])])
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        kept = simhash.one_of_each_group(docs)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect()) == want
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and "LeftSemi" not in plan
    finally:
        spark.conf.set(name, before)
