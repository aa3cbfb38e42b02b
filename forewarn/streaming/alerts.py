"""Running totals per customer and re-scoring alerts, as a stream and as a batch.

Both forms share the cleaning and the alert expressions.  The stream keeps its
counters in the checkpointed state store; the batch form computes the same
counters with chunked running sums.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import number_text
from forewarn.plans.scan import running
from forewarn.sources.io import is_folder

col = F.col

EVENT_SCHEMA = ("event_id long, customer_id string, type string, amount double, category string, "
                "ts timestamp, monthly_income double")
TOTALS = {
    "transaction_count": "long", "total_credits": "double", "total_debits": "double",
    "current_balance_estimate": "double", "payment_failures": "long", "consecutive_failures": "long",
    "last_salary_date": "timestamp", "healthcare_spend": "double", "baseline_monthly_income": "double",
}
_TOTALS_SCHEMA = ", ".join(f"{n} {t}" for n, t in TOTALS.items())


# --- sources -----------------------------------------------------------------

def kafka_events(spark: SparkSession, servers: str, topic: str = "bank_transactions", max_offsets: int = 100_000,
                 starting: str = "latest") -> DataFrame:
    """JSON transactions from Kafka.  ``max_offsets`` bounds a micro-batch, and so any one customer's share of it."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", starting).option("maxOffsetsPerTrigger", max_offsets).load())
    return parse_json(raw.select(col("value").cast("string").alias("value"),
                                 (col("partition").cast("long") * F.lit(1 << 48) + col("offset")).alias("event_id")))


def parse_json(df: DataFrame) -> DataFrame:
    """``value`` (JSON text) to event columns; an ``event_id`` column of the input orders equal timestamps."""
    payload = "customer_id string, type string, amount double, category string, timestamp string, monthly_income double"
    return df.withColumn("e", F.from_json("value", payload)).select(
        "event_id", "e.customer_id", "e.type", "e.amount", "e.category",
        F.try_to_timestamp("e.timestamp").alias("ts"), "e.monthly_income")


def file_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, max_files: int = 1, fmt: str = "parquet",
                glob: str | None = None) -> DataFrame:
    """Files of a folder as a stream; a path to one file is watched through its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if not is_folder(spark, path):
        path, _, glob = path.rpartition("/")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


# --- shared expressions ------------------------------------------------------

def clean(events: DataFrame) -> DataFrame:
    """Events with a customer and a time, absent fields filled; the others are in ``rejected``."""
    kept = events.where(col("customer_id").isNotNull() & (col("customer_id") != "") & col("ts").isNotNull())
    return kept.withColumns({n: F.coalesce(col(n), F.lit(v)) for n, v in rules.EVENT_DEFAULTS.items()})


def rejected(events: DataFrame) -> DataFrame:
    """Events that ``clean`` leaves out, with ``reason``: for a side table, so that none vanishes without a trace.

    Records that were no valid JSON have neither customer nor time.
    """
    no_customer = col("customer_id").isNull() | (col("customer_id") == "")
    reason = F.when(no_customer & col("ts").isNull(), "unreadable").when(no_customer, "no customer").when(col("ts").isNull(), "no time")
    return events.withColumn("reason", reason).where(col("reason").isNotNull())


def _amount_if(cond: Column) -> Column:
    return F.when(cond, col("amount")).otherwise(0.0)


def reasons() -> Column:
    amount, income = col("amount"), col("baseline_monthly_income")
    spike = col("healthcare_spend") / F.greatest(income * rules.RESCORE["health_income_share"], F.lit(1.0))
    large = amount / F.greatest(income, F.lit(1.0)) > rules.RESCORE["large_expense_ratio"]
    return F.array_compact(F.array(
        F.when(large, F.concat(
            F.lit("Large expense: "), number_text(amount, "₹,.0f"), F.lit(" ("),
            number_text(amount / F.greatest(income, F.lit(1.0)) * 100, ".0f"), F.lit("% of income)"))),
        F.when(col("consecutive_failures") >= rules.RESCORE["consecutive_failures"], F.concat(
            F.lit("Consecutive payment failures: "), col("consecutive_failures").cast("string"))),
        F.when(spike > rules.RESCORE["health_expense_spike"], F.concat(
            F.lit("Healthcare spike: "), number_text(spike, ".1f"), F.lit("x baseline")))))


def to_alerts(totals: DataFrame) -> DataFrame:
    """Alert rows of the events whose totals cross a threshold."""
    return totals.withColumn("reasons", reasons()).where(F.size("reasons") > 0).select(
        "customer_id", "event_id", col("ts").alias("trigger_time"), "reasons", F.lit("RESCORE").alias("action"),
        F.when(F.size("reasons") > 1, "HIGH").otherwise("MEDIUM").alias("priority"))


# --- batch form --------------------------------------------------------------

def running_totals(events: DataFrame, chunk: str = "hour") -> DataFrame:
    """Every event with the customer's totals right after it, in (ts, event_id) order."""
    is_salary, failed = col("type") == "salary", F.when(col("type") == "payment_failure", 1).otherwise(0)
    credit, debit = col("type").isin("credit", "salary"), col("type") == "debit"
    return running(
        clean(events), ["customer_id"], ["ts", "event_id"], F.date_trunc(chunk, "ts"),
        sums={
            "transaction_count": F.lit(1), "total_credits": _amount_if(credit), "total_debits": _amount_if(debit),
            "current_balance_estimate": F.when(credit, col("amount")).when(debit, -col("amount")).otherwise(0.0),
            "payment_failures": failed, "healthcare_spend": _amount_if(col("category") == "healthcare")},
        lasts={"last_salary_date": F.when(is_salary, col("ts"))},
        firsts={"baseline_monthly_income": col("monthly_income")},
        since={"consecutive_failures": (failed, is_salary)})


def alerts_batch(events: DataFrame, chunk: str = "hour") -> DataFrame:
    return to_alerts(running_totals(events, chunk))


# --- stream form -------------------------------------------------------------

def _stepper(idle_ms: int | None):
    """The per-customer step; a closure, so workers need no installed package."""
    kinds = dict(TOTALS)

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
        """Totals after each event of one customer in one micro-batch."""
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True)
        n = len(pdf)
        take = np.lexsort((pdf["event_id"].to_numpy(), pdf["ts"].to_numpy()))
        cols = {c: pdf[c].to_numpy()[take] for c in pdf.columns}
        kind, amount, ts = cols["type"], cols["amount"].astype(float), cols["ts"]
        if state.exists:
            n0, credits0, debits0, balance0, fails0, streak0, salary0, health0, income = state.get
        else:
            n0, credits0, debits0, balance0, fails0, streak0, salary0, health0 = 0, 0.0, 0.0, 0.0, 0, 0, None, 0.0
            income = float(cols["monthly_income"][0])

        salary, failed, debit = kind == "salary", kind == "payment_failure", kind == "debit"
        credit = salary | (kind == "credit")
        signed = np.where(credit, amount, np.where(debit, -amount, 0.0))
        fails = failed.cumsum()
        at_reset = np.maximum.accumulate(np.where(salary, fails, -1))
        # position of the newest salary up to each row, -1 before the first
        paid_at = np.maximum.accumulate(np.where(salary, np.arange(n), -1))
        before = np.datetime64("NaT") if salary0 is None else np.datetime64(pd.Timestamp(salary0))

        out = pd.DataFrame({
            **cols,
            "transaction_count": n0 + np.arange(1, n + 1),
            "total_credits": credits0 + np.where(credit, amount, 0.0).cumsum(),
            "total_debits": debits0 + np.where(debit, amount, 0.0).cumsum(),
            "current_balance_estimate": balance0 + signed.cumsum(),
            "payment_failures": fails0 + fails,
            "consecutive_failures": np.where(at_reset >= 0, fails - at_reset, fails + streak0),
            "last_salary_date": np.where(paid_at >= 0, ts[paid_at], before.astype(ts.dtype)),
            "healthcare_spend": health0 + np.where(cols["category"] == "healthcare", amount, 0.0).cumsum(),
            "baseline_monthly_income": np.full(n, income),
        })
        last = {c: out[c].iat[n - 1] for c in kinds}
        state.update(tuple(
            None if pd.isna(last[c]) else last[c].to_pydatetime() if t == "timestamp" else
            int(last[c]) if t == "long" else float(last[c]) for c, t in kinds.items()))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield out

    return step


def stream_totals(events: DataFrame, idle_expiry_ms: int | None = None) -> DataFrame:
    """Stateful twin of ``running_totals``.

    Events are ordered inside a micro-batch; across micro-batches they count in
    arrival order.  The source's per-trigger cap bounds what one customer can
    bring into a task.  ``idle_expiry_ms`` forgets idle customers; by default
    nothing expires.
    """
    ts_type = events.schema["ts"].dataType
    rows = clean(events).select("customer_id", "event_id", "type", "amount", "category",
                                col("ts").cast("timestamp").alias("ts"), "monthly_income")
    out = ("customer_id string, event_id long, type string, amount double, category string, ts timestamp, "
           f"monthly_income double, {_TOTALS_SCHEMA}")
    timeout = "NoTimeout" if idle_expiry_ms is None else "ProcessingTimeTimeout"
    totals = rows.groupBy("customer_id").applyInPandasWithState(
        _stepper(idle_expiry_ms), out, _TOTALS_SCHEMA, "append", timeout)
    return totals.withColumns({c: col(c).cast(ts_type) for c in ("ts", "last_salary_date")})


def alerts(events: DataFrame, idle_expiry_ms: int | None = None) -> DataFrame:
    return to_alerts(stream_totals(events, idle_expiry_ms))


def consume(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is available now, in capped micro-batches, into parquet; resumes from the checkpoint."""
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def alert_sink(stream: DataFrame, deliver, checkpoint: str):
    """Hands every micro-batch of alerts to ``deliver(df, batch_id)``; repeats of a batch carry the same id."""
    return (stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


# --- further alert inputs ----------------------------------------------------

def daily_balance_drop(events: DataFrame, drop: float = rules.RESCORE["balance_drop_pct"]) -> DataFrame:
    """Days on which a positive balance fell by more than ``drop`` within the day.

    ``previous`` is the balance that the day began with: the last closing balance, carried over days without events.
    """
    signed = F.when(col("type").isin("credit", "salary"), col("amount")).when(
        col("type") == "debit", -col("amount")).otherwise(0.0)
    # one row per customer and day before any window
    daily = clean(events).groupBy("customer_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum(signed).alias("net"))
    by_day = Window.partitionBy("customer_id").orderBy("day")
    closing = F.round(F.sum("net").over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 2)
    out = daily.withColumn("balance", closing).withColumn("previous", F.lag("balance").over(by_day))
    fell = (col("previous") - col("balance")) / F.when(col("previous") > 0, col("previous"))
    return out.where(fell > drop).select("customer_id", "day", "previous", "balance")


def late_salaries(events: DataFrame, expected_day: int = 1, days: int = rules.RESCORE["salary_delay_days"]) -> DataFrame:
    """First salary of a month more than ``days`` after the expected day."""
    first_pay = clean(events).where(col("type") == "salary").groupBy(
        "customer_id", F.date_trunc("month", "ts").alias("month")).agg(F.min("ts").alias("paid"))
    delay = F.datediff("paid", "month") - (expected_day - 1)
    return first_pay.withColumn("delay_days", delay).where(col("delay_days") > days)


def rolling_healthcare(events: DataFrame, days: int = 30, chunk: str = "hour") -> DataFrame:
    """Healthcare spending of the last ``days`` days at every event, both ends included.

    Every amount enters at its time and leaves just after ``days`` days, so the
    rolling sum is a running sum over entries and exits.
    """
    rows = clean(events).select("customer_id", "event_id", "ts", _amount_if(col("category") == "healthcare").alias("delta"))
    leave = col("ts") + F.make_dt_interval(F.lit(days)) + F.expr("INTERVAL '0.000001' SECOND")
    exits = rows.where(col("delta") != 0).select(
        "customer_id", F.lit(None).cast("long").alias("event_id"), leave.alias("ts"), (-col("delta")).alias("delta"))
    summed = running(rows.unionByName(exits), ["customer_id"], ["ts"], F.date_trunc(chunk, "ts"),
                     sums={"healthcare_spend_30d": col("delta")}, peers=True)
    return summed.where(col("event_id").isNotNull()).select(
        "customer_id", "event_id", "ts", (F.rint(col("healthcare_spend_30d") * 100) / 100 + F.lit(0.0)).alias("healthcare_spend_30d"))


def daily_healthcare(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming form: healthcare spending per customer and day, late data bounded by the watermark."""
    spend = clean(events).where(col("category") == "healthcare").withColumn(
        "ts", col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return spend.groupBy(F.window("ts", "1 day").alias("w"), "customer_id").agg(F.sum("amount").alias("spend")).select(
        "customer_id", col("w.start").alias("day"), "spend")


def upserts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes every changed row of an aggregate, open days too, with the number of its micro-batch.

    A repeated micro-batch replaces its own folder, so nothing counts twice.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
     .trigger(availableNow=True).start().awaitTermination())


def healthcare_windows(changes: DataFrame, days: int = 30) -> DataFrame:
    """Sliding windows of ``days`` days, one starting each day, from the ``upserts`` of ``daily_healthcare``.

    The newest row of a customer's day counts.  All windows with spending are there, those that are still open too; only
    one row per customer and day is copied to the windows it lies in.
    """
    daily = changes.groupBy("customer_id", "day").agg(F.max_by("spend", "batch").alias("spend"))
    start = F.explode(F.sequence(col("day") - F.make_dt_interval(F.lit(days - 1)), col("day"), F.make_dt_interval(F.lit(1))))
    return daily.withColumn("window_start", start).groupBy("customer_id", "window_start").agg(
        F.sum("spend").alias("healthcare_spend_30d")).withColumn(
        "window_end", col("window_start") + F.make_dt_interval(F.lit(days)))
