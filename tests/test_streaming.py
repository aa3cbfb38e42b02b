import pytest
from pyspark.sql import functions as F

from forewarn.sources.adapters import transactions
from forewarn.sources.io import work_dir
from forewarn.streaming import alerts

col = F.col
ROUND = ["total_credits", "total_debits", "current_balance_estimate", "healthcare_spend"]
KEYS = ["event_id", "transaction_count", "payment_failures", "consecutive_failures", "last_salary_date", "baseline_monthly_income"]


def totals(df):
    rows = df.select(*KEYS, *[(F.round(c, 2) + 0.0).alias(c) for c in ROUND]).collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture()
def feed(spark, sf):
    """Transactions in time order as five files; a third of them under one customer."""
    t = transactions(spark, sf).withColumn("ts", col("ts").cast("timestamp")).withColumn(
        "customer_id", F.when(col("event_id") % 3 == 0, "hot").otherwise(col("customer_id")))
    path = work_dir(spark, "feed")
    rows = t.orderBy("ts", "event_id").limit(1000).withColumn("part", F.ntile(5).over(
        __import__("pyspark").sql.Window.partitionBy(F.lit(0)).orderBy("ts", "event_id"))).cache()
    for i in range(1, 6):
        rows.where(col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path, rows.drop("part")


def test_stream_equals_batch_over_micro_batches_and_restart(spark, feed):
    path, rows = feed
    out = work_dir(spark, "out")
    schema = rows.schema
    first = work_dir(spark, "first")
    files = sorted(r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect())
    by_time = spark.read.parquet(*files).groupBy(F.input_file_name().alias("f")).agg(F.min("ts").alias("t")).orderBy("t").collect()
    # three files, stop, then the rest from the same checkpoint
    for chunk in (by_time[:3], by_time[3:]):
        for r in chunk:
            spark.read.parquet(r.f).coalesce(1).write.mode("append").parquet(first)
        alerts.consume(alerts.stream_totals(alerts.file_events(spark, first, schema, max_files=1)), f"{out}/d", f"{out}/c")
    got = spark.read.parquet(f"{out}/d")
    assert totals(got) == totals(alerts.running_totals(rows))
    want = alerts.alerts_batch(rows)
    again = alerts.to_alerts(got)
    assert sorted((r.event_id, tuple(r.reasons), r.priority) for r in again.collect()) == sorted(
        (r.event_id, tuple(r.reasons), r.priority) for r in want.collect())


def test_salary_resets_failures_and_empty_customers_drop(spark):
    ev = [(1, "a", "payment_failure", 1.0, None, "2024-01-01T00:00:00", 1000.0), (2, "a", "payment_failure", 1.0, None, "2024-01-01T01:00:00", 9.0),
          (3, "a", "salary", 100.0, None, "2024-01-01T02:00:00", 9.0), (4, "a", "payment_failure", 1.0, None, "2024-01-03T00:00:00", 9.0),
          (5, "", "debit", 5.0, None, "2024-01-01T00:00:00", None), (6, None, "debit", 5.0, None, "2024-01-01T00:00:00", None),
          (7, "b", None, None, "healthcare", "2024-01-01T00:00:00", None), (8, "b", "debit", 20000.0, "healthcare", "2024-01-02T00:00:00", None)]
    df = spark.createDataFrame(ev, "event_id long, customer_id string, type string, amount double, category string, s string, monthly_income double").select(
        "event_id", "customer_id", "type", "amount", "category", F.to_timestamp("s").alias("ts"), "monthly_income")
    got = {r.event_id: r for r in alerts.running_totals(df).collect()}
    assert [got[i].consecutive_failures for i in (1, 2, 3, 4)] == [1, 2, 0, 1]
    assert set(got) == {1, 2, 3, 4, 7, 8} and got[4].baseline_monthly_income == 1000.0 and got[8].baseline_monthly_income == 50000.0
    a = {r.event_id: r for r in alerts.alerts_batch(df).collect()}
    assert a[2].reasons == ["Consecutive payment failures: 2"] and a[2].priority == "MEDIUM"
    assert a[8].priority == "HIGH" and a[8].reasons == ["Large expense: ₹20,000 (40% of income)", "Healthcare spike: 8.0x baseline"]
    assert set(a) == {2, 8}


def test_kafka_json_shape(spark):
    df = spark.createDataFrame([(1, '{"customer_id":"c","type":"debit","amount":5,"timestamp":"2024-01-01T10:00:00"}'), (2, "broken")],
                               "event_id long, value string")
    a, b = alerts.parse_json(df).orderBy("event_id").collect()
    assert (a.customer_id, a.amount, a.category, a.ts.hour) == ("c", 5.0, None, 10) and b.customer_id is None


def test_rolling_window_expires(spark):
    rows = [(1, "a", "healthcare", 10.0, 0), (2, "a", "healthcare", 5.0, 30 * 86400), (3, "a", "other", 99.0, 30 * 86400 + 1), (4, "a", "healthcare", 1.0, 61 * 86400)]
    df = spark.createDataFrame(rows, "event_id long, customer_id string, category string, amount double, s long").select(
        "event_id", "customer_id", "category", "amount", F.timestamp_seconds("s").alias("ts"), F.lit("debit").alias("type"),
        F.lit(1.0).alias("monthly_income"))
    got = {r.event_id: r.healthcare_spend_30d for r in alerts.rolling_healthcare(df, 30).collect()}
    assert got == {1: 10.0, 2: 15.0, 3: 5.0, 4: 1.0}


def test_income_of_zero_still_raises_the_alert(spark):
    rows = [(1, "z", "debit", 900000.0, "other", 0.0)]
    df = spark.createDataFrame(rows, "event_id long, customer_id string, type string, amount double, category string, monthly_income double").withColumn(
        "ts", F.to_timestamp(F.lit("2024-01-01")))
    assert alerts.alerts_batch(df).first().reasons == ["Large expense: ₹900,000 (90000000% of income)"]


def test_rejected_events_are_kept_aside(spark):
    rows = [(1, "a", "2024-01-01"), (2, "", "2024-01-01"), (3, "a", None), (4, None, None)]
    df = spark.createDataFrame(rows, "event_id long, customer_id string, s string").select("event_id", "customer_id", F.to_timestamp("s").alias("ts"))
    assert {r.event_id: r.reason for r in alerts.rejected(df).collect()} == {2: "no customer", 3: "no time", 4: "unreadable"}


def test_open_windows_are_written(spark, feed):
    path, rows = feed
    out = work_dir(spark, "windows")
    alerts.upserts(alerts.daily_healthcare(alerts.file_events(spark, path, rows.schema, max_files=1), "3650 days"), f"{out}/d", f"{out}/c")
    got = alerts.healthcare_windows(spark.read.parquet(f"{out}/d"), days=2)
    spent = rows.where("category = 'healthcare'").agg(F.sum("amount")).first()[0]
    assert abs(got.agg(F.sum("healthcare_spend_30d")).first()[0] - 2 * spent) < 1e-3
    assert got.agg(F.max("window_start")).first()[0] == rows.where("category = 'healthcare'").agg(F.max(F.date_trunc("day", "ts"))).first()[0]
