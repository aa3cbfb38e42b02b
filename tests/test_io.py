import pytest
from pyspark.sql import functions as F

from forewarn import catalog
from forewarn.operators import reporting, tables
from forewarn.plans import workflow
from forewarn.sources import io


def test_fallback_order(spark, sf):
    assert io.load_best(spark, [f"{sf}/none.parquet", f"{sf}/region.parquet"]).count() == 5
    with pytest.raises(FileNotFoundError):
        io.load_best(spark, [f"{sf}/none.parquet"])


def test_work_dir_uses_the_clusters_folder(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    try:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path))
    except Exception:  # fixed for the session
        pytest.skip("setting is static in this session")
    assert io.work_dir(spark, "x").startswith(str(tmp_path))
    spark.conf.unset("spark.checkpoint.dir") if before is None else spark.conf.set("spark.checkpoint.dir", before)


def test_csv_round_trip_with_line_breaks_and_arrays(spark):
    df = spark.createDataFrame([(1, ["SMS", "Email"], 'a "b"\nc')], "id int, ch array<string>, m string")
    path = io.work_dir(spark, "csv")
    io.write_csv(df, path)
    r = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True).first()
    assert (r.ch, r.m) == ("SMS,Email", 'a "b"\nc')


def test_request_defaults(spark):
    r = tables.apply_defaults(spark.createDataFrame([("L1", None, 10.0)], "LoanID string, Age int, Income double")).first()
    assert (r.LoanID, r.Age, r.Income, r.CreditScore, r.segment_category) == ("L1", 35, 10.0, 700, "EMPLOYED")


def test_log_retention(spark):
    log = spark.range(12_000).select(F.col("id").alias("LoanID"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"))
    kept = reporting.retain_since(log, F.timestamp_seconds(F.lit(1_000_000)))
    assert kept.count() == 11_000 and kept.agg(F.min("LoanID")).first()[0] == 1000  # by age, whatever the size


def test_lookup_reaches_the_scan(spark, sf):
    plan = reporting.lookup(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", "5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert [r.v for r in reporting.lookup(df, "k", "2").collect()] == ["b"] and reporting.lookup(df, "k", "x").count() == 0


def test_workflow_writes_by_band_and_prunes(spark, sf):
    out = io.work_dir(spark, "wf")
    base = catalog.loan_snapshot(spark, sf)
    twice = base.unionByName(base.withColumn("event_timestamp", F.col("event_timestamp") + F.expr("INTERVAL 1 DAY")))
    scored, interventions, summary = workflow.run(
        spark, twice, out, ["event_timestamp"], healthcare_multiplier=F.col("healthcare_multiplier"), days_to_emi=F.lit(4))
    assert scored.count() == base.count() and summary.first().total == base.count()
    plan = scored.where(F.col("risk_band") == "MODERATE")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(risk_band" in plan
    assert interventions.count() == summary.first().interventions > 0
