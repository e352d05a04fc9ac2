"""op1's proximity matches against a plain version, for ids of both types."""

import random

import pytest

from wavelake.llm import decontaminate


@pytest.mark.parametrize("strings", [False, True])
def test_proximity(spark, strings):
    pick = random.Random(1)
    words = [f"w{k}" for k in range(9)]
    docs = [(k, " ".join(pick.choices(words, k=pick.randint(0, 60)))) for k in range(60)] + [(60, None), (61, "")]
    asked = [(k, " ".join(pick.sample(words, pick.randint(1, 3)))) for k in range(12)] + [(12, None), (13, "absent w1")]
    name = (lambda k: f"n{k}") if strings else (lambda k: k)
    kind = "string" if strings else "bigint"
    index = decontaminate.build_index(spark.createDataFrame([(name(i), t) for i, t in docs], f"doc_id {kind}, text string"), kind)
    queries = spark.createDataFrame([(name(i), t) for i, t in asked], f"item_id {kind}, text string")
    total = {w: sum((t or "").split().count(w) for _, t in docs) for w in words}
    want = []
    for i, q in asked:
        ws = sorted((q or "").split(), key=lambda w: (total.get(w, 0), w))
        for d, t in docs:
            own = (t or "").split()
            if ws:
                near = lambda p, w: any(own[k] == w for k in range(max(0, p - 2), min(len(own), p + 3)))
                want += [(name(i), name(d), p) for p, w in enumerate(own) if w == ws[0] and all(near(p, x) for x in ws[1:])]
    assert sorted(map(tuple, decontaminate.proximity_matches(index, queries, 2).collect())) == sorted(want)
