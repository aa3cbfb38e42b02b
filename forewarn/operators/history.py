"""Feature formulas over event history, and point-in-time feature retrieval.

Sums are taken per (customer, period) first, with partial aggregation before the
shuffle; windows then run over one row per period and customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import npround
from forewarn.plans.scan import running

col = F.col
CREDITS = ("credit", "salary")


def _by_period(txn: DataFrame, period: str, **aggs: Column) -> DataFrame:
    return txn.groupBy("customer_id", F.date_trunc(period, "ts").alias("period")).agg(
        *[c.alias(n) for n, c in aggs.items()])


def _whole(rows: DataFrame, period: str, values: list[str]) -> DataFrame:
    """``rows`` (customer_id, period, values) with a row of zeros for every period without events between a customer's
    first and last one."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH",
            "year": "INTERVAL 1 YEAR"}[period]
    spans = rows.groupBy("customer_id").agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    calendar = spans.select("customer_id", F.explode(F.sequence("_a", "_b", F.expr(step))).alias("period"))
    return calendar.join(rows, ["customer_id", "period"], "left").fillna(0.0, values)


def _amount_if(cond: Column) -> Column:
    return F.sum(F.when(cond, col("amount")).otherwise(0.0))


def _periods() -> Window:
    return Window.partitionBy("customer_id").orderBy("period")


def income_stability(txn: DataFrame, period: str = "month") -> DataFrame:
    """Deviation of income per period over its mean, in percent (ISI); periods without income count as zero."""
    monthly = _whole(_by_period(txn, period, income=_amount_if(col("type").isin(*CREDITS))), period, ["income"])
    return monthly.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("periods"),
        npround(F.try_divide(F.stddev_samp("income"), F.avg("income")) * 100, 4).alias("isi"))


def expenditure_volatility(txn: DataFrame, period: str = "month") -> DataFrame:
    """Deviation of spending per period (EVS); periods without spending count as zero."""
    monthly = _whole(_by_period(txn, period, spend=_amount_if(col("type") == "debit")), period, ["spend"])
    return monthly.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("periods"), npround(F.stddev_samp("spend"), 4).alias("evs"))


def salary_delay(txn: DataFrame, expected_day: int = 1, period: str = "month") -> DataFrame:
    """Mean days from the expected day of the month to the first salary in it (SDT)."""
    first_pay = _by_period(txn.where(col("type") == "salary"), period, paid=F.min("ts"))
    delay = F.datediff("paid", col("period")) - (expected_day - 1)
    return first_pay.groupBy("customer_id").agg(npround(F.avg(delay), 4).alias("sdt"))


def deposits_before_due(deposits: DataFrame, dues: DataFrame, days: int = 3, chunk: str = "day") -> DataFrame:
    """Share of instalments with a deposit in the ``days`` days before the due time (CDPS).

    A deposit lies in ``[due - days, due]`` exactly when the latest deposit up to
    the due time does, so the range join becomes one running "last" per customer
    and no pair of rows is ever formed.

    deposits: customer_id, ts      dues: customer_id, due_id, ts
    """
    rows = deposits.select("customer_id", "ts", F.lit(0).alias("is_due"), col("ts").alias("deposit_ts")).unionByName(
        dues.select("customer_id", "ts", F.lit(1).alias("is_due"), F.lit(None).cast("timestamp").alias("deposit_ts")))
    seen = running(rows, ["customer_id"], ["ts", "is_due"], F.date_trunc(chunk, "ts"),
                   lasts={"last_deposit": col("deposit_ts")})
    covered = col("last_deposit") >= col("ts") - F.make_dt_interval(F.lit(days))
    return seen.where(col("is_due") == 1).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("dues"), F.count_if(covered).alias("covered")).withColumn(
        "cdps", npround(col("covered") / col("dues") * 100, 4))


def payment_timing(txn: DataFrame, expected_day: int = 15) -> DataFrame:
    """1 - deviation of the payment day over the expected day (PTC)."""
    return txn.where(col("type") == "payment").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("payments"),
        npround(1 - F.stddev_samp(F.dayofmonth("ts")) / expected_day, 4).alias("ptc"))


def signed_amount() -> Column:
    return F.when(col("type").isin(*CREDITS), col("amount")).when(col("type") == "debit", -col("amount")).otherwise(0.0)


def balance_trajectory(txn: DataFrame, period: str = "month", opening: float = 0.0) -> DataFrame:
    """(closing - opening) / opening balance per period (ABT)."""
    net = _by_period(txn, period, net=F.sum(signed_amount()))
    upto = F.sum("net").over(_periods().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = npround(F.lit(opening) + upto, 2)
    start = npround(F.lit(opening) + upto - col("net"), 2)
    return net.select("customer_id", "period", start.alias("start_balance"), end.alias("end_balance")).withColumn(
        "abt", npround(F.try_divide(col("end_balance") - col("start_balance"), col("start_balance")), 4))


def healthcare_ratio(txn: DataFrame, period: str = "month", trailing: int = 3) -> DataFrame:
    """Healthcare spending of a period over the mean of the ``trailing`` periods before it, those without spending as 0."""
    spend = _whole(_by_period(txn.where(col("category") == "healthcare"), period, current_spend=F.sum("amount")), period, ["current_spend"])
    baseline = F.avg("current_spend").over(_periods().rowsBetween(-trailing, -1))
    return spend.withColumn("baseline", baseline).select(
        "customer_id", "period", npround(col("current_spend"), 2).alias("current_spend"),
        npround(col("baseline"), 2).alias("baseline"),
        npround(F.try_divide(col("current_spend"), col("baseline")), 4).alias("healthcare_ratio"))


def gig_variance(txn: DataFrame) -> DataFrame:
    """Deviation of daily income over its mean, days without income between the first and last one as 0."""
    daily = _whole(_by_period(txn.where(col("type").isin(*CREDITS)), "day", income=F.sum("amount")), "day", ["income"])
    return daily.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("days"),
        npround(F.try_divide(F.stddev_samp("income"), F.avg("income")), 4).alias("income_cv_daily"))


def discretionary_drop(txn: DataFrame, period: str = "month", discretionary=("entertainment",)) -> DataFrame:
    """Discretionary share of spending per period and its change against the period before (DSR)."""
    debit = txn.where(col("type") == "debit")
    share = _by_period(debit, period, disc=_amount_if(col("category").isin(*discretionary)), total=F.sum("amount"))
    share = _whole(share, period, ["disc", "total"]).withColumn("dsr", F.try_divide(col("disc"), F.greatest(col("total"), F.lit(1.0))) * 100)
    prev = F.lag("dsr").over(_periods())
    return share.select("customer_id", "period", npround(col("dsr"), 4).alias("dsr"),
                        npround(col("dsr") - prev, 4).alias("dsr_change"))


# --- feature views -----------------------------------------------------------

def view_features(name: str, df: DataFrame) -> tuple[int, list[str]]:
    """(ttl in hours, features of the view that the frame has)."""
    ttl, names = rules.FEATURE_VIEWS[name]
    return ttl, [n for n in names if n in df.columns]


def point_in_time(spine: DataFrame, view: DataFrame, entity: str, ts: str, features: list[str], ttl_hours: float,
                  spine_key: str, tiebreak: str, chunk: str = "month") -> DataFrame:
    """Newest view row with ``ts <= t`` and ``ts > t - ttl`` for every spine row.

    Spine and view are merged in time order and the last view row is carried
    forward, chunk by chunk, so neither pairs nor a whole entity meet in one task.
    """
    own = [c for c in spine.columns if c not in (entity, ts)]
    payload = F.struct(col(ts).alias("ts"), *[col(c) for c in features])
    left = spine.select(
        col(entity), col(ts), F.lit(1).alias("_spine"), F.lit(None).cast(view.schema[tiebreak].dataType).alias("_tie"),
        F.struct(*own).alias("_own"))
    right = view.where(col(entity).isNotNull()).select(
        col(entity), col(ts), F.lit(0).alias("_spine"), col(tiebreak).alias("_tie"),
        payload.alias("_view"))
    rows = left.unionByName(right, allowMissingColumns=True)
    seen = running(rows, [entity], [ts, "_spine", "_tie"], F.date_trunc(chunk, ts), lasts={"_hit": col("_view")})
    fresh = col("_hit.ts") > col(ts) - F.make_dt_interval(secs=F.lit(ttl_hours * 3600).cast("decimal(18,6)"))
    return seen.where(col("_spine") == 1).select(
        entity, ts, "_own.*", F.when(fresh, col("_hit.ts")).alias("feature_ts"),
        *[F.when(fresh, col(f"_hit.{c}")).alias(c) for c in features])


def online_latest(view: DataFrame, entity: str, ts: str, features: list[str], ttl_hours: float, as_of: Column,
                  tiebreak: str) -> DataFrame:
    """Newest row per entity up to ``as_of``, features blank once older than the ttl."""
    payload = F.struct(col(ts).alias("ts"), *[col(c) for c in features])
    newest = view.where(col(ts) <= as_of).groupBy(entity).agg(
        F.max_by(payload, F.struct(col(ts), col(tiebreak))).alias("v"))
    fresh = col("v.ts") > as_of - F.make_dt_interval(secs=F.lit(ttl_hours * 3600).cast("decimal(18,6)"))
    return newest.select(entity, col("v.ts").alias("feature_ts"),
                         *[F.when(fresh, col(f"v.{c}")).alias(c) for c in features])
