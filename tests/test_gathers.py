"""The gathers format: round trips, splits, pruned columns and files, all-or-nothing writes."""

import json
import os
import tempfile

import pytest

from wavelake.sources import gathers


@pytest.fixture(scope="module")
def place(spark):
    gathers.register(spark)
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def traces(spark, n=100, nt=7):
    return spark.range(n).selectExpr("id div 10 AS shot", "id AS rcv", "if(id % 2 = 0, 'vx', 'vz') AS component", f"transform(sequence(1, {nt}), k -> id + k / 7D) AS amp")


def test_round_trip_in_many_splits(spark, place):
    want = sorted(map(tuple, traces(spark).collect()))
    path = f"file://{place}/a"
    traces(spark).repartitionByRange(3, "shot").write.format("gathers").mode("append").option("dt", 0.004).save(path)
    read = spark.read.format("gathers").option("splitBytes", 7 * 8 * 9).load(path)
    assert sorted(map(tuple, read.collect())) == want
    assert read.rdd.getNumPartitions() >= 100 // 9 and len(gathers.read_manifest(path)["files"]) == 3
    one = f"{place}/one"  # one file, many tasks
    traces(spark).coalesce(1).write.format("gathers").mode("append").save(one)
    read = spark.read.format("gathers").option("splitBytes", 7 * 8 * 9).load(one)
    assert len(gathers.read_manifest(one)["files"]) == 1 and read.rdd.getNumPartitions() == 12 and sorted(map(tuple, read.collect())) == want
    with pytest.raises(Exception, match="there are gathers"):
        traces(spark).write.format("gathers").mode("append").save(one)


def test_pruned(spark, place):
    path = f"{place}/pruned"
    traces(spark).repartitionByRange(5, "shot").write.format("gathers").mode("append").save(path)
    heads = spark.read.format("gathers").schema("rcv bigint, shot bigint").load(path)
    assert heads.columns == ["rcv", "shot"] and heads.agg({"rcv": "sum"}).first()[0] == 99 * 50
    reader = gathers.GatherReader(spark.createDataFrame([], gathers.SCHEMA).schema, {"path": path})
    assert len(list(reader.pushFilters([gathers.EqualTo(("shot",), 3), gathers.LessThan(("rcv",), 5)]))) == 2
    assert len(reader.partitions()) == 1
    for f in gathers.read_manifest(path)["files"]:  # of the files, only that of shot 3 is still there
        if not f["first_shot"] <= 3 <= f["last_shot"]:
            os.remove(f"{path}/{f['name']}")
    assert spark.read.format("gathers").load(path).where("shot = 3").count() == 10


def test_kinds_edges_and_overwrite(spark, place):
    path = f"{place}/f4"
    traces(spark, 4).drop("component").write.format("gathers").mode("append").option("kind", "f4").save(path)
    rows = spark.read.format("gathers").load(path).orderBy("rcv").collect()
    assert [r.component for r in rows] == [""] * 4 and abs(rows[3].amp[0] - 3 - 1 / 7) < 1e-6
    traces(spark, 2, 5).write.format("gathers").mode("overwrite").save(path)
    assert spark.read.format("gathers").load(path).count() == 2 and len([f for f in os.listdir(path) if f.endswith(".gathers")]) == len(gathers.read_manifest(path)["files"])
    empty = f"{place}/empty"
    traces(spark, 0).write.format("gathers").mode("append").save(empty)
    assert spark.read.format("gathers").load(empty).count() == 0


@pytest.mark.parametrize("bad", ["null", "array(1D, null)", "array(1D)"])
def test_refused(spark, place, bad):
    path = f"{place}/bad{len(bad)}"
    broken = traces(spark, 20).selectExpr("shot", "rcv", f"if(rcv = 13, {bad}, amp) AS amp")
    with pytest.raises(Exception, match="trace"):
        broken.write.format("gathers").mode("append").save(path)
    assert not os.path.exists(f"{path}/_manifest.json")


def test_other_file(spark, place):
    path = f"{place}/other"
    traces(spark, 3).coalesce(1).write.format("gathers").mode("append").save(path)
    name = gathers.read_manifest(path)["files"][0]["name"]
    with open(f"{path}/{name}", "r+b") as file:
        file.write(b"nonsense")
    with pytest.raises(Exception, match="isn't a file of these gathers"):
        spark.read.format("gathers").load(path).collect()
    assert json.load(open(f"{path}/_manifest.json"))["nt"] == 7
