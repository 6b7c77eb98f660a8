"""The keyed table (S2) and the id registry (E2 over batches)."""
import os

import pytest
from pyspark.sql import functions as F

from shopsmith.operators import id_registry as R
from shopsmith.session import scratch_path
from shopsmith.streaming import keyed as K


def files(target):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{target.removeprefix('file:')}/rows") for f in names if f.endswith(".parquet")}


def rows(spark, target):
    return {r["id"]: (r["name"], r["is_active"], r["is_visible"]) for r in K.read_keyed(spark, target).collect()}


def start(spark, n=500):
    target = scratch_path(spark, "t-keyed")
    old = spark.range(n).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(False).alias("is_active"), (F.col("id") % 2 == 0).alias("is_visible"))
    K.create_keyed(old, target, buckets=16)
    return target


def test_a_small_batch_touches_only_its_buckets(spark):
    target = start(spark)
    before = files(target)
    batch = spark.createDataFrame([(1, "other"), (7, None), (1000, "new"), (1000, "newer")], "id long, name string")
    K.upsert_batch(spark, batch, target, 0)
    added = files(target) - before
    assert before <= files(target) and 1 <= len(added) <= 3 and all("__kind=delta/__batch=0" in f for f in added)
    got = rows(spark, target)
    assert len(got) == 501 and got[1] == ("n1", True, True) and got[7] == ("n7", True, True) and got[3] == ("n3", False, False)
    assert got[1000] == ("newer", True, True)
    # a replay writes the same folders again
    K.upsert_batch(spark, batch, target, 0)
    assert len(files(target)) == len(before) + len(added) and rows(spark, target) == got


def test_compaction_rewrites_full_buckets_only(spark):
    target = start(spark)
    for n in range(4):
        K.upsert_batch(spark, spark.createDataFrame([(5, f"x{n}"), (2000 + n, f"y{n}")], "id long, name string"), target, n)
    before, got = files(target), rows(spark, target)
    hot = spark.range(1).select(F.pmod(F.xxhash64(F.lit(5).cast("long")), F.lit(16))).first()[0]
    assert K.compact(spark, target, most_deltas=3) == [hot]
    other = {f for f in before if f"__bucket={hot}/" not in f}
    assert other <= files(target) and rows(spark, target) == got and got[5] == ("n5", True, True)
    assert all("__kind=base/__batch=3" in f for f in files(target) - other)
    # clean-up cut off half way: an old folder left behind changes nothing
    K.upsert_batch(spark, spark.createDataFrame([(5, "x0")], "id long, name string"), target, 0)
    assert rows(spark, target) == got
    assert K.compact(spark, target, most_deltas=3) == []


def test_columns_and_order_of_a_batch(spark):
    target = scratch_path(spark, "t-keyed")
    assert K.read_keyed(spark, target) is None and K.compact(spark, target) == []
    K.upsert_batch(spark, spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "no key", 9)], "id long, name string, at int"), target, 0, order="at")
    K.upsert_batch(spark, spark.createDataFrame([(2, "extra", "c")], "id long, more string, name string"), target, 1)
    K.upsert_batch(spark, spark.createDataFrame([(3,)], "id long"), target, 2)
    assert rows(spark, target) == {1: ("a", True, True), 2: ("c", True, True), 3: (None, True, True)}
    with pytest.raises(ValueError):
        K.create_keyed(spark.range(1), target)


def ids(spark, registry):
    return {r["key"]: r["id"] for r in R.registered(spark, registry).collect()}


def test_ids_never_change(spark):
    registry = scratch_path(spark, "t-ids")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "url string")
    got = {r["url"]: r["id"] for r in R.register_ids(keys("b", "a", "b", None), registry, 0, "url", first_id=10).collect()}
    assert got == {"a": 10, "b": 11}
    assert {r["url"]: r["id"] for r in R.register_ids(keys("aa", "b"), registry, 1, "url").collect()} == {"b": 11, "aa": 12}
    R.register_ids(keys("z", "a"), registry, 2, "url")
    want = {"a": 10, "b": 11, "aa": 12, "z": 13}
    assert ids(spark, registry) == want
    # replays of the last batch, and a batch with nothing new
    R.register_ids(keys("z", "a"), registry, 2, "url")
    R.register_ids(keys("a"), registry, 3, "url")
    R.register_ids(keys(), registry, 4, "url")
    R.register_ids(keys("0"), registry, 5, "url")
    assert ids(spark, registry) == want | {"0": 14}


def test_a_batch_that_did_not_finish_does_not_count(spark):
    registry = scratch_path(spark, "t-ids")
    R.register_ids(spark.createDataFrame([("a",)], "url string"), registry, 0, "url")
    # ids of batch 1 written, its range not
    spark.createDataFrame([("lost", 99, 3, 1)], "key string, id long, bucket int, batch long").write.mode("append").partitionBy("bucket", "batch").parquet(f"{registry}/ids")
    assert ids(spark, registry) == {"a": 1}
    got = R.register_ids(spark.createDataFrame([("b",), ("a",)], "url string"), registry, 1, "url")
    assert {r["url"]: r["id"] for r in got.collect()} == {"a": 1, "b": 2}
