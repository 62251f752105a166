"""Running totals against plain whole-key windows, with hot, NULL and ordinary keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from capledger.operators.ordered import latest, running


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(7)
    start = dt.datetime(2024, 3, 30, 23, 50)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"k{rng.randrange(400)}"
        ts = None if rng.random() < 0.1 else start + dt.timedelta(seconds=rng.randrange(4000))
        data.append((key, ts, i, rng.choice([None, 1, 2, 5])))
    data += [("minute", start, 3000 + i, 1) for i in range(1500)]  # one instant
    return spark.createDataFrame(data, "key string, ts timestamp_ntz, id long, v int").cache()


@pytest.mark.parametrize("inclusive", [True, False])
def test_equals_plain_window(frame, inclusive):
    latest_set = F.when(F.col("v").isNotNull(), F.struct("ts", "id", "v"))
    got = running(
        frame, ["key"], ["ts", "id"], {"total": ("sum", F.col("v")), "last": ("max", latest_set)}, inclusive
    )
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = frame.withColumn("total", F.coalesce(F.sum("v").over(w), F.lit(0))).withColumn("last", F.max(latest_set).over(w))
    assert got.count() == frame.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_an_answer_does_not_depend_on_the_size_of_the_key(spark):
    rows = [(None, 1), (dt.datetime(2024, 1, 1), 2), (dt.datetime(2024, 1, 1, 0, 3), 3)]
    small = spark.createDataFrame([("a", *r) for r in rows], "key string, ts timestamp_ntz, id long")
    assert sorted(r.n for r in running(small, ["key"], ["ts", "id"], {"n": ("sum", F.lit(1))}).collect()) == [1, 2, 3]


def test_hot_key_is_spread_over_tasks(frame, monkeypatch):
    from capledger.operators import ordered

    written = []
    real = ordered.stage
    monkeypatch.setattr(ordered, "stage", lambda df, name: written.append(real(df, name)) or written[-1])
    frame.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the frame is small
    try:
        got = running(frame, ["key"], ["ts", "id"], {"n": ("sum", F.lit(1))})
    finally:
        frame.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert written[0].where("key = 'minute'").select("_part").distinct().count() > 1
    assert got.where("key = 'minute'").agg(F.max("n")).first()[0] == 1500


def test_no_broadcast_is_forced(frame):
    text = running(frame, ["key"], ["ts", "id"], {"n": ("sum", F.lit(1))})._jdf.queryExecution().logical().toString()
    assert "broadcast" not in text.lower()


def test_empty(frame):
    assert running(frame.limit(0), ["key"], ["ts", "id"], {"n": ("sum", F.lit(1))}).isEmpty()


def test_latest_prefers_later_and_set_orders(spark):
    df = spark.createDataFrame(
        [("a", 1, None, "x"), ("a", 2, 5, "y"), ("a", 3, 4, "z"), ("b", 1, None, "w")], "k string, id int, at int, v string"
    )
    assert sorted(map(tuple, latest(df, "k", ["at", "id"], ["v"]).collect())) == [("a", "y"), ("b", "w")]
