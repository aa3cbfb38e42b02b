import random
from collections import defaultdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from forewarn.operators import documents, history, tables
from forewarn.plans.scan import running
from forewarn.plans.topk import leading_chunks, top_k

col = F.col


def skewed(spark, n=3000, seed=1):
    """A third of the rows under one key."""
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", rng.randrange(0, 500), rng.randrange(-5, 6), rng.random() < 0.1)
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, t long, v long, reset boolean")


def test_running_equals_plain_window_on_skewed_keys(spark):
    df = skewed(spark)
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.when(col("reset"), col("v"))
    got = running(df, ["key"], ["t", "id"], F.floor(col("t") / 20), sums={"s": col("v")}, lasts={"l": last},
                  firsts={"f": col("v")}, since={"c": (F.lit(1), col("reset"))})
    plain = df.select("*", F.sum("v").over(w).alias("s"), F.last(last, True).over(w).alias("l"), F.first("v").over(w).alias("f"))
    key = ["id", "s", "l", "f"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))
    streak, want = defaultdict(int), {}
    for r in df.orderBy("key", "t", "id").collect():
        streak[r.key] = 1 if r.reset else streak[r.key] + 1
        want[r.id] = streak[r.key]
    assert {r.id: r.c for r in got.collect()} == want


def test_running_without_key_and_with_peers(spark):
    df = skewed(spark, 500)
    got = running(df, [], ["t"], F.floor(col("t") / 50), sums={"s": col("v")}, peers=True)
    w = Window.partitionBy(F.lit(0)).orderBy("t")
    want = df.withColumn("s", F.sum("v").over(w))
    assert sorted((r.id, r.s) for r in got.collect()) == sorted((r.id, r.s) for r in want.collect())


def test_running_shuffles_on_key_and_chunk(spark):
    plan = running(skewed(spark, 50), ["key"], ["t"], F.floor(col("t") / 50), sums={"s": col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "_chunk" in plan


def test_top_k_is_exact(spark):
    df = skewed(spark)
    order = [F.desc("v"), F.asc("id")]
    got = top_k(df, 7, order, by=["key"], salt_key="id")
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("rank <= 7")
    cols = ["key", "id", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert [r.id for r in top_k(df, 5, order, salt_key="id").orderBy("rank").collect()] == [
        r.id for r in df.orderBy(*order).limit(5).collect()]


def test_keep_last_limits_before_the_shuffle(spark):
    kept = tables.keep_last(skewed(spark), "key", ["t", "id"])
    assert kept.count() == 41 and kept.select("key").distinct().count() == 41
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_split_is_exact_per_class(spark):
    df = skewed(spark).withColumn("y", (col("key") == "hot").cast("int"))
    out = tables.stratified_split(df, "y", "id")
    rows = {r.y: (r.n, r.t) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.sum("is_train").alias("t")).collect()}
    assert all(t == int(n * 0.8) for n, t in rows.values()) and sum(n for n, _ in rows.values()) == 3000
    again = tables.stratified_split(df.repartition(3), "y", "id")
    assert {r.id for r in out.where("is_train = 1").collect()} == {r.id for r in again.where("is_train = 1").collect()}


def test_label_encode(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, s string")
    assert {r.id: r.s_code for r in tables.label_encode(df, "s").collect()} == {1: 1, 2: 0, 3: -1, 4: 1}


def test_deposits_before_due_against_brute_force(spark):
    rng = random.Random(3)
    keys = ["hot"] * 5 + ["a", "b", "c"]
    dep = [(rng.choice(keys), rng.randrange(0, 86400 * 40)) for _ in range(120)]
    due = [(rng.choice(keys), i, rng.randrange(0, 86400 * 40)) for i in range(80)]
    ts = lambda c: F.timestamp_seconds(c).alias("ts")
    d = spark.createDataFrame(dep, "customer_id string, s long").select("customer_id", ts("s"))
    u = spark.createDataFrame(due, "customer_id string, due_id long, s long").select("customer_id", "due_id", ts("s"))
    want = defaultdict(lambda: [0, 0])
    for k, _, t in due:
        want[k][0] += 1
        want[k][1] += any(k == k2 and t - 3 * 86400 <= t2 <= t for k2, t2 in dep)
    got = {r.customer_id: [r.dues, r.covered] for r in history.deposits_before_due(d, u, 3).collect()}
    assert got == dict(want)


def test_point_in_time_ttl_edges(spark):
    spine = spark.sql("SELECT 'a' AS k, TIMESTAMP '2024-01-10' AS ts, 1L AS id UNION ALL SELECT 'a', TIMESTAMP '2024-03-01', 2L "
                      "UNION ALL SELECT 'b', TIMESTAMP '2024-01-10', 3L UNION ALL SELECT 'a', TIMESTAMP '2024-01-11', 4L")
    view = spark.sql("SELECT 'a' AS k, TIMESTAMP '2024-01-10' AS ts, 9L AS vid, 5.0D AS x UNION ALL SELECT 'a', TIMESTAMP '2023-12-01', 8L, 4.0D")
    got = {r.id: r.x for r in history.point_in_time(spine, view, "k", "ts", ["x"], 24, "id", "vid").collect()}
    # same instant counts, exactly one ttl later does not
    assert got == {1: 5.0, 2: None, 3: None, 4: None}


def test_profiles_of_a_hot_customer_are_paged(spark):
    rows = [("hot", i, "HDFC", "SAVINGS" if i % 2 else "LOAN", 1.5, 2.0, 3.0) for i in range(95)] + [("x", 1, "PaySense", "LOAN", None, 2.0, 3.0)]
    acc = spark.createDataFrame(rows, "customer_id string, account_key long, fip_id string, account_type string, balance double, emi double, outstanding double")
    docs = documents.assemble(acc, 40, chunk=F.floor(col("account_key") / 10)).cache()
    assert sorted((r.customer_id, r.page, len(r.accounts)) for r in docs.collect()) == [("hot", 0, 40), ("hot", 1, 40), ("hot", 2, 15), ("x", 0, 1)]
    assert documents.flatten(docs).where("is_primary").count() == 1
    flat = {r.customer_id: r for r in documents.rollup_flat(acc).collect()}
    assert flat["hot"].total_balance_all_banks == 142.5 and flat["x"].has_fintech_loans and not flat["hot"].has_fintech_loans
    # figures do not depend on the paging
    assert {r.customer_id: r for r in documents.rollup(docs).collect()} == flat
    assert {r.customer_id: r.fip_id for r in documents.primary_accounts(acc).collect()} == {"hot": "HDFC", "x": None}
    docs.unpersist()


def test_rows_without_time_or_key_are_kept(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "a", 5, 2), (3, None, 7, 4), (4, "a", 60, 8)], "id int, key string, t long, v long")
    got = running(df, ["key"], ["t", "id"], F.floor(col("t") / 50), sums={"s": col("v")})
    assert {r.id: r.s for r in got.collect()} == {1: 1, 2: 3, 3: 4, 4: 11}


def test_label_codes_with_a_common_beginning(spark):
    df = spark.range(5000).select(F.format_string("https://host/%05d", F.col("id")).alias("u"))
    codes = tables.label_codes(df, "u").orderBy("u").collect()
    assert [r.u_code for r in codes] == list(range(5000))


def test_short_ttl_and_numeric_ties(spark):
    spine = spark.sql("SELECT 'a' AS k, TIMESTAMP '2024-01-10 10:00:00' AS ts, 1L AS id UNION ALL SELECT 'a', TIMESTAMP '2024-01-10 10:20:00', 2L "
                      "UNION ALL SELECT 'a', TIMESTAMP '2024-01-10 10:30:00', 3L")
    view = spark.sql("SELECT 'a' AS k, TIMESTAMP '2024-01-10 10:00:00' AS ts, 9L AS vid, 9.0D AS x UNION ALL SELECT 'a', TIMESTAMP '2024-01-10 10:00:00', 10L, 10.0D")
    got = {r.id: r.x for r in history.point_in_time(spine, view, "k", "ts", ["x"], 0.5, "id", "vid").collect()}
    assert got == {1: 10.0, 2: 10.0, 3: None}


def test_periods_without_events_count(spark):
    txn = spark.sql("SELECT 'c' AS customer_id, 'credit' AS type, 'x' AS category, 30.0D AS amount, TIMESTAMP '2024-01-01' AS ts "
                    "UNION ALL SELECT 'c', 'credit', 'x', 30.0D, TIMESTAMP '2024-01-03'")
    r = history.gig_variance(txn).first()
    assert r.days == 3 and abs(r.income_cv_daily - 0.866) < 1e-3


def test_leading_chunks_hold_the_top_rows(spark):
    df = skewed(spark)
    for desc in (False, True):
        part = leading_chunks(df, 400, F.floor(col("t") / 20), descending=desc)
        order = [F.desc("t") if desc else F.asc("t"), F.asc("id")]
        assert 400 <= part.count() < 800
        assert [r.id for r in top_k(part, 400, order, salt_key="id").orderBy("rank").collect()] == [
            r.id for r in df.orderBy(*order).limit(400).collect()]
    assert leading_chunks(df, 10**6, F.floor(col("t") / 20)).count() == 3000


def test_subsample_size_and_repeatability(spark):
    df = skewed(spark)
    a = {r.id for r in tables.random_subsample(df, 250, "id").collect()}
    assert len(a) == 250 and a == {r.id for r in tables.random_subsample(df.repartition(3), 250, "id").collect()}
    assert tables.random_subsample(df, 5000, "id").count() == 3000
