import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from coffer.operators import assign_periods, detect_pay_dates, not_near, pay_periods
from conftest import D, M, pay_dates, rows, txns


def test_periods_end_the_day_before_the_next(spark):
    df = pay_periods(pay_dates(spark, ["2026-04-14", "2026-03-13", "2026-05-14", "2026-05-14"]))
    assert rows(df, "period_start", "period_end") == [
        (D("2026-03-13"), D("2026-04-13")),
        (D("2026-04-14"), D("2026-05-13")),
        (D("2026-05-14"), D("2030-01-01")),
    ]


def test_assignment_equals_the_range_join(spark):
    rng = random.Random(7)
    day = lambda: (date(2026, 1, 1) + timedelta(days=rng.randrange(200))).isoformat()
    ledger = txns(spark, [(rng.choice("abc"), day(), "c", i + 1) for i in range(300)])
    starts = spark.createDataFrame(
        [(a, D(day())) for a in "ab" for _ in range(6)], "account_id string, pay_date date"
    )
    periods = pay_periods(starts)
    as_of = rows(assign_periods(ledger, periods), "id", "pay_period_start", "pay_period_end")
    by_range = rows(
        assign_periods(ledger, periods, method="range"), "id", "pay_period_start", "pay_period_end"
    )
    assert as_of == by_range and len(as_of) == 300
    assert any(r[1] is None for r in as_of) and any(r[1] is not None for r in as_of)


def test_days_after_a_closed_period_get_none(spark):
    periods = pay_periods(pay_dates(spark, ["2026-01-01"]), open_end=D("2026-01-31"))
    df = assign_periods(txns(spark, [("2026-01-31", "c", 1), ("2026-02-01", "c", 1)]), periods)
    assert rows(df, "transaction_date", "pay_period_start") == [
        (D("2026-01-31"), D("2026-01-01")),
        (D("2026-02-01"), None),
    ]


def salaries(spark, dates, amount=5000):
    return txns(spark, [(d, "salary", amount) for d in dates])


def accepted(found):
    return [r[0].isoformat() for r in rows(found.new_dates, "pay_date")]


def test_detection_skips_dates_near_confirmed_and_accepted_ones(spark):
    found = detect_pay_dates(
        salaries(spark, ["2026-01-01", "2026-01-05", "2026-01-15", "2026-01-22", "2026-01-23"]),
        pay_dates(spark, ["2025-12-30"]),
        "salary",
    )
    assert accepted(found) == ["2026-01-15", "2026-01-23"]
    assert rows(found.summary) == [("a", 2, 3, 5)]
    row = found.new_dates.first()
    assert (row["source"], row["note"]) == ("auto", "Detected from Salary transaction")


def test_detection_on_the_seed_ledger(spark):
    dates = ["2026-02-15", "2026-02-28", "2026-03-15", "2026-03-31", "2026-04-01"]
    found = detect_pay_dates(salaries(spark, dates), None, "salary")
    assert accepted(found) == dates[:-1]


def test_detection_by_category_table_and_minimum(spark):
    ledger = txns(spark, [("2026-01-01", "s1", 3000), ("2026-02-01", "s1", 2999.99), ("2026-03-01", "x", 9000)])
    wanted = spark.createDataFrame([("s1",)], "category_id string")
    assert accepted(detect_pay_dates(ledger, None, wanted)) == ["2026-01-01"]


def test_detection_equals_the_sequential_walk(spark):
    rng = random.Random(3)
    data, expected = [], []
    for account in ("a", "b", "c"):
        days = [date(2026, 1, 1) + timedelta(days=rng.randrange(300)) for _ in range(80)]
        confirmed = sorted({date(2026, 1, 1) + timedelta(days=rng.randrange(300)) for _ in range(4)})
        data += [(account, d, M(4000)) for d in days]
        taken = list(confirmed)
        for d in sorted(days):
            if all(abs((d - t).days) > 7 for t in taken):
                taken.append(d)
                expected.append((account, d))
        data += [(account, c, M(1)) for c in confirmed]
    df = spark.createDataFrame(data, "account_id string, transaction_date date, amount decimal(12,2)")
    df = df.withColumn("category_id", F.lit("salary"))
    confirmed = df.where("amount = 1").select("account_id", F.col("transaction_date").alias("pay_date"))
    found = detect_pay_dates(df, confirmed, "salary")
    assert rows(found.new_dates, "account_id", "pay_date") == sorted(expected, key=repr)


def test_not_near_is_inclusive(spark):
    left = not_near(
        pay_dates(spark, ["2026-01-08", "2026-01-09"]), pay_dates(spark, ["2026-01-01"]), 7
    )
    assert rows(left, "pay_date") == [(D("2026-01-09"),)]


def test_no_salaries_and_no_pay_dates(spark):
    none = salaries(spark, [])
    found = detect_pay_dates(none, None, "salary")
    assert accepted(found) == [] and found.summary.count() == 0
    assert pay_periods(found.new_dates).count() == 0
    assert assign_periods(txns(spark, [("2026-01-01", "c", 1)]), pay_periods(found.new_dates)).first()[
        "pay_period_start"
    ] is None
