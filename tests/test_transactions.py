import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from row_lists import rows
from pyspark.sql import functions as F

from capledger.operators import transactions as tx
from capledger.plans import catalogue
from capledger.schemas import TABLES
from capledger.sources import adapters, tables
from capledger.streaming import monitor

T0 = dt.datetime(2024, 1, 1)


def swipe(i, amount, limit, label, holder="CH-1001"):
    money = lambda v: None if v is None else Decimal(v)
    return (f"TX-{i}", holder, money(amount), money(limit), T0 + dt.timedelta(minutes=i), label)


@pytest.fixture(scope="module")
def swipes(spark):
    data = [
        swipe(1, "5000.00", "5000.00", 0),  # at the limit
        swipe(2, "5000.01", "5000.00", 1),
        swipe(3, "900.00", None, 0),  # unknown limit
        swipe(4, "1600.00", "1500.00", 0, "CH-1004"),  # over the limit, labelled 0
        swipe(5, None, "1500.00", 0, "CH-1004"),
    ]
    return spark.createDataFrame(data, TABLES["simulated_transactions"])


def test_breach_rule(swipes):
    assert [r.transaction_id for r in tx.breaches(swipes, F.col("transaction_time")).orderBy("transaction_id").collect()] == ["TX-2", "TX-4"]
    assert rows(tx.breach_by_cardholder(swipes)) == [("CH-1001", 3, 1), ("CH-1004", 2, 1)]
    metrics = tx.feed_metrics(swipes, tx.is_breach(), "n").first()
    assert tuple(metrics) == (5, pytest.approx(12500.01 / 4), 2)
    assert [r.transaction_id for r in tx.transaction_feed(swipes, 2).collect()] == ["TX-5", "TX-4"]


def test_breaches_by_holder_at_known_scale(spark, sf):
    if not sf.endswith("sf0.01"):
        pytest.skip("counts are those of sf0.01")
    got = {r.cardholder_id: r.breaches for r in tx.breach_by_cardholder(adapters.transactions(spark, sf)).collect()}
    assert got == {"CH-1001": 19, "CH-1002": 343, "CH-1003": 0, "CH-1004": 531}


def test_counted_training_equals_row_training(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    data = adapters.transactions(spark, sf)
    counted = tx.train(data)
    by_row = Pipeline(
        stages=[VectorAssembler(inputCols=tx.FEATURES, outputCol="features"), LogisticRegression(labelCol=tx.LABEL)]
    ).fit(data)
    assert counted.stages[-1].coefficients.toArray() == pytest.approx(by_row.stages[-1].coefficients.toArray(), rel=1e-3)
    scored = counted.transform(data)
    assert BinaryClassificationEvaluator(labelCol=tx.LABEL).evaluate(scored) > 0.9
    out = tx.score(counted, data)
    assert out.where("predicted_label = 0 AND fraud_score <> 0").isEmpty()
    assert out.where("(alert = 'High Risk (ML)') <> (fraud_score > 0.5)").isEmpty()
    assert out.count() == data.count()


def test_model_round_trip_and_fallback(spark, sf, folder):
    data = adapters.transactions(spark, sf)
    model = tx.train(data)
    tx.save_model(model, f"{folder}/fraud_model")
    tx.save_model(model, f"{folder}/fraud_model")  # replaces
    again = tx.load_model(f"{folder}/fraud_model")
    assert rows(tx.scored_feed(again, data)) == rows(tx.scored_feed(model, data))
    newest = {r.transaction_id for r in tx.transaction_feed(data).collect()}
    assert {r.transaction_id for r in tx.feed_or_fallback(model, data).collect()} == newest
    assert tx.feed_or_fallback(None, data).count() == 10


def _feed(spark, path):
    return spark.readStream.schema(TABLES["simulated_transactions"]).parquet(path)


def test_breach_stream_restarts_without_repeats(spark, swipes, folder):
    source, sink, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"
    swipes.write.parquet(source)

    def run():
        query = monitor.breach_monitor(_feed(spark, source), sink, checkpoint, available_now=True)
        query.awaitTermination()
        return rows(tables.scan_declared(spark, sink, "breach_events").drop("breached_at"))

    want = rows(tx.breaches(swipes, F.col("transaction_time")).drop("breached_at"))
    assert run() == want
    assert run() == want  # nothing new
    spark.createDataFrame([swipe(6, "10.00", "5.00", 0)], TABLES["simulated_transactions"]).write.mode("append").parquet(source)
    assert len(run()) == len(want) + 1
    assert monitor.raw_fallback(spark, sink, 2).count() == 2


def test_metrics_stream_carries_on(spark, swipes, folder):
    source, sink, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint"
    swipes.where("transaction_id <> 'TX-1'").write.parquet(source)

    def run():
        monitor.metrics_stream(_feed(spark, source), tx.is_breach(), "n", sink, checkpoint, available_now=True).awaitTermination()
        return tuple(monitor.current_metrics(spark, sink).first())

    assert run() == (4, pytest.approx(7500.01 / 3), 2)
    swipes.where("transaction_id = 'TX-1'").write.mode("append").parquet(source)
    assert run() == (5, pytest.approx(12500.01 / 4), 2)


def test_scored_stream_equals_batch(spark, sf):
    streamed = catalogue.QUERIES["scored_stream"](spark, sf)
    data = adapters.transactions(spark, sf)
    batch = tx.score(tx.train(data), data).select("transaction_id", "alert")
    assert streamed.select("transaction_id", "alert").exceptAll(batch).isEmpty()
    assert streamed.count() == batch.count()


def test_stream_reads_a_folder_of_part_files(spark, sf, folder):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{folder}/events.parquet")
    sink, checkpoint = f"{folder}/out", f"{folder}/checkpoint"
    feed = adapters.transactions_from(tables.stream(spark, folder, "events", files_per_batch=1))
    monitor.breach_monitor(feed, sink, checkpoint, available_now=True, breached_at=F.col("transaction_time")).awaitTermination()
    want = tx.breaches(adapters.transactions(spark, sf), F.col("transaction_time"))
    got = tables.scan_declared(spark, sink, "breach_events")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert len([d for d in os.listdir(f"{checkpoint}/commits") if not d.startswith(".")]) == 3


def test_context_bundle_document(spark, sf):
    row = catalogue.QUERIES["context_bundle"](spark, sf).where("context_json like '%lineage%'").first()
    doc = json.loads(row.context_json)
    assert set(doc) == {"rwa_comparison", "lineage", "dashboard_metrics"}
    assert doc["lineage"]["run_id"] == row.run_b
    cell = doc["rwa_comparison"][0]
    assert cell["rwa_delta"] == pytest.approx(cell["rwa_updated"] - cell["rwa_baseline"])
