"""Nested account profiles: flatten, roll up, assemble, read tax maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forewarn.functions import rules
from forewarn.functions.semantics import npround
from forewarn.plans.scan import running

col = F.col

# exact sums that do not depend on the order of rows
MONEY = "decimal(18,4)"

ACCOUNT_TYPE = ("struct<fip_id:string,account_type:string,masked_account:string,balance:double,is_primary:boolean,"
                "loan_type:string,emi:double,outstanding:double,interest_rate:double>")
PROFILE_SCHEMA = (
    f"customer_id string, consent_id string, timestamp string, accounts array<{ACCOUNT_TYPE}>, "
    "mutual_funds array<struct<fund_name:string,current_value:double>>, "
    "tax_records struct<itr:map<string,struct<gross_total_income:double>>>, "
    "_metadata struct<total_emi_other_banks:double,num_banks:long,total_balance_all_banks:double,has_fintech_loans:boolean>")


def flatten(profiles: DataFrame) -> DataFrame:
    """One row per account."""
    return profiles.select("customer_id", F.inline("accounts"))


def rollup(profiles: DataFrame) -> DataFrame:
    """Per customer, over all pages: EMI total, savings banks, balance total, any fintech lender."""
    return rollup_flat(profiles.select("customer_id", F.inline_outer("accounts")))


def rollup_flat(accounts: DataFrame) -> DataFrame:
    """The same totals per customer from flat account rows, pre-aggregated before the shuffle."""
    def total(field: str) -> Column:
        return npround(F.sum(F.coalesce(field, F.lit(0.0)).cast(MONEY)).cast("double"), 2)

    return accounts.groupBy("customer_id").agg(
        total("emi").alias("total_emi_other_banks"),
        F.count_distinct(F.when(col("account_type") == "SAVINGS", col("fip_id"))).alias("num_banks"),
        total("balance").alias("total_balance_all_banks"),
        F.coalesce(F.max(col("fip_id").isin(rules.FINTECH_LENDERS)), F.lit(False)).alias("has_fintech_loans"))


def primary_accounts(accounts: DataFrame, order: str = "account_key") -> DataFrame:
    """Bank and balance of each customer's first savings account in ``order``; null for customers without one."""
    first = F.when(col("account_type") == "SAVINGS", col(order))
    return accounts.groupBy("customer_id").agg(F.min_by(F.struct("fip_id", "balance"), first).alias("a")).select("customer_id", "a.*")


def assemble(accounts: DataFrame, page_size: int, order: str = "account_key", chunk: Column | None = None) -> DataFrame:
    """Profiles in pages: rows (customer, page) with ``page_size`` accounts each, the last page with the rest.

    The output format is chosen by the caller; no array and no task grows with a hot customer.  Figures per customer
    come from flat rows (``rollup_flat``, ``primary_accounts``) or from all pages (``rollup``), never from one page.
    The first savings account in ``order`` is the primary one.
    """
    chunk = F.floor(col(order) / 65536) if chunk is None else chunk
    is_savings = col("account_type") == "SAVINGS"
    numbered = running(accounts, ["customer_id"], [order], chunk, sums={
        "_row": F.lit(1), "_savings": F.when(is_savings, 1).otherwise(0)})
    account = F.struct(
        order, "fip_id", "account_type", F.lit(None).cast("string").alias("masked_account"), "balance",
        F.when(is_savings, col("_savings") == 1).alias("is_primary"), F.lit(None).cast("string").alias("loan_type"),
        "emi", "outstanding", F.lit(None).cast("double").alias("interest_rate"))
    pages = numbered.withColumn("page", F.floor((col("_row") - 1) / page_size)).repartition("customer_id", "page")
    packed = pages.groupBy("customer_id", "page").agg(F.array_sort(F.collect_list(account)).alias("a"))
    return packed.select("customer_id", "page", F.transform("a", lambda a: a.dropFields(order)).alias("accounts"))


def to_json_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select("customer_id", F.to_json(F.struct(*profiles.columns)).alias("value"))


def primary_account() -> Column:
    """First account flagged primary, null when a profile has none."""
    return F.get(F.filter("accounts", lambda a: F.coalesce(a["is_primary"], F.lit(False))), 0)


def fund_total() -> Column:
    return F.aggregate("mutual_funds", F.lit(0.0), lambda acc, f: acc + F.coalesce(f["current_value"], F.lit(0.0)))


def gross_income(year: str) -> Column:
    return F.try_element_at(col("tax_records.itr"), F.lit(year))["gross_total_income"]


def income_by_year(profiles: DataFrame) -> DataFrame:
    return profiles.select("customer_id", F.explode("tax_records.itr").alias("tax_year", "r")).select(
        "customer_id", "tax_year", col("r.gross_total_income").alias("gross_total_income"))


def join_loans(profiles: DataFrame, loans: DataFrame) -> DataFrame:
    """Profile rows with label and income of the customer's loans (one loan row per customer expected)."""
    income = "monthly_income" if "monthly_income" in loans.columns else "Income"
    target = "target" if "target" in loans.columns else "Default"
    return profiles.join(
        loans.select(col("customer_id").cast("string").alias("customer_id"), col(target).alias("target"),
                     col(income).alias("monthly_income")), "customer_id")
