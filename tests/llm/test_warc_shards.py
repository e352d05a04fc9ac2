"""op10: shards of uneven ids, null ids, wide ids, and files that differ from the manifest."""

import pytest
from pyspark.sql import functions as F

from wavelake.llm import warc


def shards_of(pages, shard_bytes):
    plain = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    shard, n = warc.shard_of(plain, shard_bytes)
    rows = plain.select("page_id", shard.alias("shard"), (F.octet_length("payload") + 500).alias("n")).orderBy("page_id").collect()
    sizes = {}
    for r in rows:
        assert r.shard is not None and 0 <= r.shard < n, r
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n
    own = [r.shard for r in rows if r.page_id is not None]
    assert own == sorted(own)  # ranges of ids
    return sizes


def pages_of(spark, ids):
    return spark.createDataFrame([(i, f"u{k}", "x" * (100 + k % 700)) for k, i in enumerate(ids)], "page_id bigint, url string, html string")


@pytest.mark.parametrize("ids", ["even", "outlier", "signs", "powers", "nulls"])
def test_no_shard_is_much_over_its_size(spark, ids):
    made = {
        "even": range(6000),
        "outlier": [*range(6000), 1 << 62],
        "signs": [-(1 << 63), (1 << 63) - 1, *range(-3000, 3000)],
        "powers": sorted({(1 << k) + j for k in range(0, 63, 3) for j in range(300)}),
        "nulls": [None] * 3000 + list(range(3000)),
    }[ids]
    sizes = shards_of(pages_of(spark, list(made)), 200_000)
    assert max(sizes.values()) <= 2 * 200_000 and len(sizes) >= sum(sizes.values()) / 400_000


def test_round_trip_of_wide_ids(spark):
    pages = pages_of(spark, [-(1 << 63), -5, None, None, 0, 7, (1 << 63) - 1]).withColumn("shard", F.lit("mine"))
    place = warc.write(pages, shard_bytes=1000)
    assert sorted((str(r.page_id), r.payload_bytes) for r in warc.read(spark, place).collect()) == sorted((str(r.page_id), len(r.html)) for r in pages.collect())


def test_other_bytes_are_noticed(spark):
    place = warc.write(pages_of(spark, range(5)))
    name = spark.read.parquet(f"{place}/manifest").first().file
    local = place.removeprefix("file:")
    with open(f"{local}/{name}", "r+b") as file:
        whole = bytearray(file.read())
        whole[4] ^= 1  # the time stamp of a gzip header: records read the same
        file.seek(0)
        file.write(whole)
    with pytest.raises(Exception, match="another digest"):
        warc.read(spark, place).collect()
