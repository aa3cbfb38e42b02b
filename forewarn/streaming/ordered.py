"""Transaction totals and alerts of a stream in event time: each event counts once the watermark has passed it.

A micro-batch is staged with the events that still wait.  Those up to the watermark are totalled in time order by the
chunked running sums of the batch form, on top of what the customers' last totals carry over, so a customer with a third of
all events is spread over many tasks.  Every micro-batch is one commit of ``sources.versions``: a killed one leaves nothing
half done, and a repeated one changes nothing.  Days and months are closed by the watermark as well, so a salary that never
comes is seen.  Each micro-batch reads the customers' last totals once; choose triggers of minutes, not of seconds.

Tables under ``root``: ``totals`` (every event with the totals right after it), ``drops`` and ``overdue`` (alerts), ``late``
(events that came behind the watermark; they are in no total), ``waiting`` and ``state``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.sources import versions
from forewarn.streaming.alerts import TOTALS, clean, running_totals

col = F.col
DAY = 86_400_000_000
EVENT = ["event_id", "customer_id", "type", "amount", "category", "ts", "monthly_income"]
SUMS = ["transaction_count", "total_credits", "total_debits", "current_balance_estimate", "payment_failures", "healthcare_spend"]
#: Versions of the customers' last totals that are read together before they are written as one.
MERGE_EVERY = 16


def _micros(ts: Column | str) -> Column:
    return F.unix_micros((col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _signed() -> Column:
    return F.when(col("type").isin("credit", "salary"), col("amount")).when(col("type") == "debit", -col("amount")).otherwise(0.0)


def _state(spark: SparkSession, root: str) -> DataFrame | None:
    """The last totals of every customer: the row of the newest version."""
    rows = versions.read(spark, root, "state")
    if rows is None:
        return None
    own = [c for c in rows.columns if c not in ("customer_id", "version")]
    return rows.groupBy("customer_id").agg(F.max_by(F.struct(*own), "version").alias("s")).select("customer_id", "s.*")


def _carried(totals: DataFrame, state: DataFrame | None) -> DataFrame:
    """``totals`` of the released events alone, on top of the customers' last totals."""
    if state is None:
        return totals
    old = state.select("customer_id", F.struct(*TOTALS).alias("_old"))
    out = totals.join(old, "customer_id", "left")
    # a salary among the released events has reset the failures; before it those carried over still count
    streak = F.when(col("last_salary_date").isNull(), F.coalesce(col("_old.consecutive_failures"), F.lit(0))).otherwise(0)
    return out.withColumns({
        **{c: col(c) + F.coalesce(col(f"_old.{c}"), F.lit(0)) for c in SUMS},
        "consecutive_failures": col("consecutive_failures") + streak,
        "last_salary_date": F.coalesce("last_salary_date", "_old.last_salary_date"),
        "baseline_monthly_income": F.coalesce("_old.baseline_monthly_income", "baseline_monthly_income"),
    }).select(*totals.columns)


def _days(totals: DataFrame, state: DataFrame | None, old: int | None) -> DataFrame:
    """Opening and closing balance per customer and day that was open at the last watermark."""
    rows = totals.select("customer_id", "ts", "event_id", col("current_balance_estimate").alias("after"),
                         (col("current_balance_estimate") - _signed()).alias("before"))
    if state is not None:
        still_open = state.where(_micros(F.date_trunc("day", "last_ts")) + DAY > old)
        rows = rows.unionByName(still_open.select("customer_id", col("last_ts").alias("ts"), F.lit(None).cast("long").alias("event_id"),
                                                  col("current_balance_estimate").alias("after"), col("day_open").alias("before")))
    at = F.struct("ts", "event_id")
    return rows.groupBy("customer_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.round(F.min_by("before", at), 2).alias("previous"), F.round(F.max_by("after", at), 2).alias("balance"))


def _fallen(days: DataFrame, share: float) -> DataFrame:
    fell = (col("previous") - col("balance")) / F.when(col("previous") > 0, col("previous"))
    return days.where(fell > share).select("customer_id", "day", "previous", "balance")


def _deadline(month: Column, expected_day: int, days: int) -> Column:
    """The instant, in microseconds, at which a month's salary is overdue."""
    return _micros(month + F.make_dt_interval(F.lit(expected_day + days)))


def _unpaid(first_seen: DataFrame, paid: DataFrame, old: int | None, mark: int | Column, expected_day: int, days: int) -> DataFrame:
    """(customer_id, month) of the deadlines after ``old`` up to ``mark`` without a row in ``paid``."""
    if not 1 <= expected_day + days <= 28:
        raise ValueError("the deadline must lie within the month")
    mark = F.lit(mark) if isinstance(mark, int) else mark
    kind = first_seen.schema["first_seen"].dataType
    start = F.date_trunc("month", "first_seen")
    if old is not None:
        start = F.greatest(start, F.date_trunc("month", F.timestamp_micros(F.lit(old)).cast(kind)))
    stop = F.date_trunc("month", F.timestamp_micros(mark).cast(kind))
    due = first_seen.where(start <= stop).withColumn("month", F.explode(F.sequence(start, stop, F.expr("INTERVAL 1 MONTH"))))
    at = _deadline(col("month"), expected_day, days)
    due = due.where((at <= mark) & (_micros("first_seen") < at) & (F.lit(True) if old is None else at > old))
    return due.select("customer_id", "month").join(paid, ["customer_id", "month"], "left_anti")


def overdue_salaries(events: DataFrame, until: Column, expected_day: int = 1, days: int = rules.RESCORE["salary_delay_days"]) -> DataFrame:
    """Months without a salary up to ``days`` days after the expected day, of customers seen before that, as known at ``until``.

    ``paid`` is the month's first salary, which came later; null where none ever came.  Batch form.
    """
    rows = clean(events).where(col("ts") <= until)
    month = F.date_trunc("month", "ts")
    first_pay = rows.where(col("type") == "salary").groupBy("customer_id", month.alias("month")).agg(F.min("ts").alias("paid"))
    in_time = first_pay.where(_micros("paid") < _deadline(col("month"), expected_day, days)).select("customer_id", "month")
    seen = rows.groupBy("customer_id").agg(F.min("ts").alias("first_seen"))
    return _unpaid(seen, in_time, None, _micros(until), expected_day, days).join(first_pay, ["customer_id", "month"], "left")


def step(batch: DataFrame | None, source: int | None, root: str, delay: float = 86_400, chunk: str = "hour",
         drop: float = rules.RESCORE["balance_drop_pct"], expected_day: int = 1,
         salary_days: int = rules.RESCORE["salary_delay_days"], spark: SparkSession | None = None) -> None:
    """One micro-batch.  ``delay``: seconds that the watermark stays behind the newest event.

    Without a batch, the stream ends: the watermark goes to the end of the newest event's day.
    """
    spark = spark or batch.sparkSession
    if source is not None and versions.is_committed(spark, root, source):
        return
    last = versions.newest(spark, root)
    version, old = (last.version + 1, last.mark) if last else (0, None)

    parts = []
    if batch is not None:
        behind = F.lit(False) if old is None else _micros("ts") <= old
        parts.append(clean(batch).select(*EVENT, behind.alias("late")))
    if last is not None:
        before = versions.read(spark, root, "waiting").where(~col("late") & (F.lit(True) if old is None else _micros("ts") > old))
        parts.append(before.select(*EVENT, "late"))
    if not parts:
        return
    staged = versions.stage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), root, "waiting", version)
    top = staged.where(~col("late")).agg(
        F.max(_micros("ts")).alias("ts"), F.max(_micros(F.date_trunc("day", "ts"))).alias("day")).first()
    mark = old
    if top.ts is not None:
        passed = top.day + DAY if batch is None else top.ts - int(delay * 1e6)
        mark = passed if old is None else max(old, passed)

    state = _state(spark, root)
    ready = staged.where(~col("late") & (_micros("ts") <= (mark if mark is not None else -(1 << 62)))).select(*EVENT)
    totals = versions.stage(_carried(running_totals(ready, chunk), state), root, "totals", version)
    days = _days(totals, state, old)
    versions.stage(staged.where("late").select(*EVENT), root, "late", version)

    # the released customers' last totals; all customers where versions are merged or a deadline has passed
    own = totals.groupBy("customer_id").agg(
        F.max_by(F.struct(*TOTALS), F.struct("ts", "event_id")).alias("t"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_ts"))
    opened = days.groupBy("customer_id").agg(F.max_by("previous", "day").alias("day_open"))
    changed = own.join(opened, "customer_id").select("customer_id", "t.*", "first_seen", "last_ts", "day_open")
    if state is not None:
        seen = state.select("customer_id", col("first_seen").alias("_seen"))
        changed = changed.join(seen, "customer_id", "left").withColumn("first_seen", F.coalesce("_seen", "first_seen")).drop("_seen")
    changed = versions.stage(changed, root, "state", version)
    everyone = changed if state is None else changed.unionByName(state.join(changed, "customer_id", "left_anti"))

    closed = mark is not None
    ended = days.where(_micros(col("day")) + DAY <= (mark if closed else 0))
    versions.stage(_fallen(ended if closed else ended.limit(0), drop), root, "drops", version)
    month = F.date_trunc("month", "ts")
    salaries = totals.where(col("type") == "salary").where(_micros("ts") < _deadline(month, expected_day, salary_days))
    paid = salaries.select("customer_id", month.alias("month"))
    if state is not None:
        paid = paid.unionByName(state.where(col("last_salary_date").isNotNull()).select(
            "customer_id", F.date_trunc("month", "last_salary_date").alias("month")))
    unpaid = _unpaid(everyone.select("customer_id", "first_seen"), paid, old, mark if closed else 0, expected_day, salary_days)
    versions.stage(unpaid if closed else unpaid.limit(0), root, "overdue", version)

    since = dict.fromkeys(("totals", "drops", "overdue", "late"), 0) | {"waiting": version, "state": last.since["state"] if last else 0}
    if version - since["state"] >= MERGE_EVERY:
        # in a folder of its own first: the state that is read must not be overwritten
        merged = versions.stage(everyone, root, "merged", version)
        versions.stage(merged, root, "state", version)
        since["state"] = version
    versions.commit(spark, root, version, since, source, mark)


def finish(spark: SparkSession, root: str, **options) -> None:
    """Ends the stream: all waiting events count, and the newest event's day is closed."""
    step(None, None, root, spark=spark, **options)


def consume(stream: DataFrame, root: str, checkpoint: str, **options) -> None:
    """Processes what is available now in the source's micro-batches; resumes from the checkpoint."""
    (stream.writeStream.foreachBatch(lambda df, i: step(df, i, root, **options)).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All committed rows of ``totals``, ``drops``, ``overdue`` or ``late``."""
    return versions.read(spark, root, name, whole=True).drop("version")
