import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from forewarn.operators import history, online
from forewarn.sources import versions
from forewarn.sources.adapters import transactions
from forewarn.sources.io import work_dir
from forewarn.streaming import alerts, ordered
from test_streaming import totals

col = F.col
SCHEMA = "event_id long, customer_id string, type string, amount double, category string, ts timestamp, monthly_income double"


@pytest.fixture(scope="module")
def feed(spark, sf):
    """Transactions with a third of them under one customer, shuffled by up to two days, in six slices."""
    t = transactions(spark, sf).withColumn("ts", col("ts").cast("timestamp")).withColumn(
        "customer_id", F.when(col("event_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), col("event_id") % 20)))
    arrival = F.unix_seconds("ts") + F.pmod(F.hash("event_id"), F.lit(2 * 86400))
    start = t.agg(F.min(F.unix_seconds("ts"))).first()[0]
    rows = t.withColumn("slice", F.least(F.floor((arrival - start) / (5 * 86400)), F.lit(5)).cast("int"))
    path = work_dir(spark, "ordered-feed")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def played(spark, feed, order=range(6), delay=3 * 86400):
    root = work_dir(spark, "ordered")
    for i in order:
        ordered.step(feed.where(col("slice") == i).drop("slice"), i, root, delay=delay)
    return root


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_late_and_shuffled_events_total_like_the_batch(spark, feed):
    root = played(spark, feed, [0, 1, 1, 2, 3, 0, 4, 5])  # repeated batches change nothing
    before = ordered.table(spark, root, "totals").count()
    assert 0 < before < feed.count()
    ordered.finish(spark, root)
    events = feed.drop("slice")
    got = ordered.table(spark, root, "totals")
    assert ordered.table(spark, root, "late").isEmpty()
    assert totals(got) == totals(alerts.running_totals(events))
    want = alerts.daily_balance_drop(events)
    assert rows_of(ordered.table(spark, root, "drops")) == rows_of(want) and not want.isEmpty()
    end = F.date_trunc("day", F.lit(events.agg(F.max("ts")).first()[0])) + F.make_dt_interval(F.lit(1))
    unpaid = ordered.overdue_salaries(events, end).select("customer_id", "month")
    assert rows_of(ordered.table(spark, root, "overdue")) == rows_of(unpaid) and not unpaid.isEmpty()


def test_merged_state_and_events_behind_the_watermark(spark, feed, monkeypatch):
    monkeypatch.setattr(ordered, "MERGE_EVERY", 2)
    root = played(spark, feed, delay=0)
    ordered.finish(spark, root)
    late = ordered.table(spark, root, "late")
    got = ordered.table(spark, root, "totals")
    assert late.count() > 0 and late.count() + got.count() == feed.count()
    assert totals(got) == totals(alerts.running_totals(feed.drop("slice").join(late, "event_id", "left_anti")))


def test_killed_between_tables_and_manifest(spark, feed, monkeypatch):
    root = played(spark, feed, [0, 1])
    whole = ordered.table(spark, root, "totals").count()

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versions, "commit", killed)
        ordered.step(feed.where("slice = 2").drop("slice"), 2, root, delay=3 * 86400)
    assert ordered.table(spark, root, "totals").count() == whole
    for i in (2, 3, 4, 5):
        ordered.step(feed.where(col("slice") == i).drop("slice"), i, root, delay=3 * 86400)
    ordered.finish(spark, root)
    assert totals(ordered.table(spark, root, "totals")) == totals(alerts.running_totals(feed.drop("slice")))


def test_stream_of_files(spark, feed):
    path, root = work_dir(spark, "ordered-files"), work_dir(spark, "ordered")
    for i in range(6):
        feed.where(col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)
        if i in (2, 5):  # stopped after three files
            ordered.consume(alerts.file_events(spark, path, SCHEMA), root, f"{root}/checkpoint", delay=3 * 86400)
    ordered.finish(spark, root)
    assert totals(ordered.table(spark, root, "totals")) == totals(alerts.running_totals(feed.drop("slice")))


def test_a_salary_that_never_comes_or_comes_late(spark):
    def on(day, month=1):
        return dt.datetime(2024, month, day, 12)

    ev = [(1, "never", "debit", on(2)), (2, "late", "debit", on(2)), (3, "late", "salary", on(9)), (4, "intime", "salary", on(6)),
          (5, "new", "debit", on(20)), (6, "intime", "salary", on(1, 2)), (7, "late", "salary", on(3, 2)), (8, "x", "debit", on(1, 3))]
    df = spark.createDataFrame([(i, c, t, 1.0, None, ts, 1.0) for i, c, t, ts in ev], SCHEMA)
    want = {("never", 1), ("late", 1), ("never", 2), ("new", 2)}
    batch = ordered.overdue_salaries(df, F.lit(dt.datetime(2024, 3, 2)))
    assert {(r.customer_id, r.month.month) for r in batch.collect()} == want
    assert {r.customer_id: r.paid for r in batch.where("month(month) = 1").collect()} == {"never": None, "late": on(9)}
    root = work_dir(spark, "ordered")
    for i, ids in enumerate([[1, 2, 4], [3], [5, 6], [7, 8]]):
        ordered.step(df.where(col("event_id").isin(ids)), i, root, delay=0)
    ordered.finish(spark, root)
    assert {(r.customer_id, r.month.month) for r in ordered.table(spark, root, "overdue").collect()} == want
    with pytest.raises(ValueError):
        ordered.overdue_salaries(df, F.lit(dt.datetime(2024, 3, 2)), expected_day=25)


def test_nothing_and_unusable_events(spark):
    root = work_dir(spark, "ordered")
    ordered.finish(spark, root)
    empty = spark.createDataFrame([], SCHEMA)
    ordered.step(empty, 0, root)
    ordered.step(spark.createDataFrame([(1, "", "debit", 1.0, None, dt.datetime(2024, 1, 1), 1.0), (2, "a", "debit", 1.0, None, None, 1.0)], SCHEMA), 1, root)
    ordered.finish(spark, root)
    assert all(ordered.table(spark, root, n).isEmpty() for n in ("totals", "drops", "overdue", "late"))


def test_online_store_equals_a_full_reading(spark):
    rng = random.Random(5)
    rows = [(f"e{min(rng.randrange(12), 6)}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 30)), i, rng.random(), None if i % 7 == 0 else float(i))
            for i in range(300)] + [("e1", None, 999, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long, a double, b double").repartition(4).withColumn("part", col("id") % 9)
    path, root = work_dir(spark, "view"), work_dir(spark, "online")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    what = dict(entity="k", ts="ts", features=["a", "b"], ttl_hours=48, tiebreak="id")
    with pytest.raises(ValueError):
        online.latest(spark, root, as_of=F.current_timestamp(), **what)
    for i in (0, 1, 2, 2, 3, 4, 0, 5, 6, 7, 8, 8):
        online.publish(df.where(col("part") == i), i, root, history=5 * 86400, every=3, **what)
    assert versions.newest(spark, root).mark is not None and versions.read(spark, root, "rows").count() < 300
    for hours in (24 * 25, 24 * 26 + 7, 24 * 31, 24 * 40):
        at = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours))
        want = history.online_latest(df.where(col("ts").isNotNull()), as_of=at, **what)
        assert rows_of(online.latest(spark, root, as_of=at, **what)) == rows_of(want)
    with pytest.raises(ValueError):
        online.latest(spark, root, as_of=F.lit(dt.datetime(2024, 1, 3)), **what)
