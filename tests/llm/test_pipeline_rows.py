"""The pipeline's rows against brute force, with null and repeated ids."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline


def made():
    rng = np.random.default_rng(6)
    text = {x: " ".join(f"{x}{i}" for i in rng.integers(0, 1000, 60)) for x in "abcdefgh"}
    item = " ".join(f"q{i}" for i in range(14))
    dirty = lambda x: f"{text[x]} {' '.join(item.split()[2:13])} end"
    key = "AKIA" + "A1" * 8
    docs = [(5, text["a"]), (5, text["b"]), (9, text["b"] + " more"), (None, dirty("c")), (None, text["d"]), (None, None), (7, text["e"]), (7, dirty("f")), (8, text["g"]), (8, text["g"]), (10, f"{text['h']} {key} end"), (11, "")]
    return docs, item, key


def brute(docs, item, key):
    words = lambda t: (t or "").lower().split()
    sha = lambda t: hashlib.sha256(" ".join(words(t)).encode()).hexdigest()
    grams = lambda ws, n: {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
    own = sorted({(i, sha(t), t or "") for i, t in docs if i is not None})
    group = list(range(len(own)))
    for x in range(len(own)):
        for y in range(x):
            g, h = grams(words(own[x][2]), 5), grams(words(own[y][2]), 5)
            if own[x][1] == own[y][1] or g and h and len(g & h) / len(g | h) >= 0.8:
                group = [group[y] if v == group[x] else v for v in group]
    firsts = [(own[k][0], own[k][2]) for k in sorted({group.index(v) for v in group})]
    left = firsts + [(i, t) for i, t in docs if i is None]
    windows = grams(item.split(), 10)
    left = [(i, t) for i, t in left if not windows & grams(words(t), 10)]
    return Counter((i, (t or "").replace(key, "[SECRET]")) for i, t in left)


def test_run(spark, tmp_path):
    docs, item, key = made()
    spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(docs, item, key)


def test_decontamination_by_row(spark, tmp_path):
    docs, item, _ = made()
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = Counter(map(tuple, corpus_pipeline.drop_contaminated(spark, rows, str(tmp_path)).collect()))
    assert got == Counter((i, t) for i, t in docs if not (t or "").endswith("q12 end"))
