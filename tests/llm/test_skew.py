"""Joins and groups of hot keys against plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.llm import skew
from tessel.storage import Stored


def test_hot_keys_join_and_group_as_others_do(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_KEYS", 10)
    store = Stored(spark, "test")
    rows = store.put(spark.range(400).select(F.when(F.col("id") < 300, 0).when(F.col("id") < 390, F.col("id") % 30).alias("k"), F.col("id").alias("v")), "rows")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).where("n > 1")
    want = sorted(map(tuple, rows.join(groups.drop("n"), "k").select("k", "v", "s").collect()))
    assert sorted(map(tuple, skew.split_join(rows, groups, ["k"], "n", 400).select("k", "v", "s").collect())) == want and len(want) == 390
    some = rows.where("k is not null")
    found = skew.with_groups(store, store.put(some, "some"), ["k"], "g", s=F.sum("v"), n=F.count("*")).where("n > 1").select("k", "v", "s")
    assert sorted(map(tuple, found.collect())) == want
