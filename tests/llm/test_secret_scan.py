"""op4: values that all documents hold, empty tables, and texts of very many spans."""

import time

from pyspark.sql import functions as F

from wavelake.llm import secret_scan


def test_one_secret_in_every_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("token=abcdef123456 and key sk_OWN_"), F.sha2(F.col("id").cast("string"), 256)).alias("text"), (F.col("id") % 7).cast("string").alias("source"))
    rows = secret_scan.secret_report(docs.repartition(5)).collect()
    assert len(rows) == 3000 and {(r.n_assign, r.n_example, r.n_live) for r in rows} <= {(1, 1, 1), (1, 1, 2)}
    kept = secret_scan.redact(docs.limit(40)).collect()
    assert all("token=abcdef123456" in r.text and r.text.endswith("sk_OWN_[SECRET]") or r.text.endswith("[SECRET]") for r in kept)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert secret_scan.secret_report(docs).count() == 0


def test_tokens_that_meet_base_spans(spark):
    """A token that touches the end of a base span stays, one that overlaps any base span goes."""
    hexes = "0123456789abcdef" * 2
    text = f"x {hexes}ZZZ y token=abc123{hexes}, sk-Live{'0Aa-' * 8} {hexes}"
    row = secret_scan.secret_report(spark.createDataFrame([(1, text, "a")], "doc_id bigint, text string, source string")).first()
    at = text.index("sk-Live")
    assert [x for x in row.spans.split(",") if x.startswith("owner")] == [f"owner:{at}:{at + 7 + 32}"]


def test_many_spans_cost_in_proportion(spark):
    def took(n):
        docs = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(" ".join(f"{k:024x}" for k in range(n))).alias("text"), F.lit("a").alias("source"))
        began = time.time()
        row = secret_scan.secret_report(docs).first()
        assert row.n_hex == n and row.spans.endswith(f"hex:{25 * (n - 1)}:{25 * n - 1}")
        return time.time() - began

    took(100)
    few = took(4000)
    assert took(16_000) < 4.5 * max(few, 1.0)
