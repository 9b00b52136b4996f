from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coffer.functions import dates, money
from coffer.keys import key_list
from coffer.operators.validation import failed_rules
from coffer.sources import conform, date_dim, seed_reference
from conftest import D, M, rows


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_month_bounds_roll_over_the_year():
    assert dates.month_bounds(date(2026, 12, 20)) == (date(2026, 12, 1), date(2027, 1, 1))
    assert dates.month_bounds("2026-02") == (date(2026, 2, 1), date(2026, 3, 1))


def test_calendar_and_fiscal_attributes(spark):
    dim = {r["date"]: r for r in date_dim(spark).collect()}
    assert len(dim) == 1095
    before, first = dim[D("2026-03-13")], dim[D("2026-03-14")]
    assert (before["fiscal_month_label"], before["first_of_fiscal_month"]) == ("2026-02", D("2026-02-14"))
    assert (first["fiscal_month_label"], first["first_of_fiscal_month"]) == ("2026-03", D("2026-03-14"))
    sunday = dim[D("2026-03-15")]
    assert (sunday["day_of_week"], sunday["day_name"], sunday["is_weekend"]) == (0, "Sunday", True)
    assert dim[D("2026-01-05")]["fiscal_year"] == 2025
    padded = date_dim(spark, D("2026-03-15"), D("2026-03-15"), pad_names=True).first()
    assert padded["day_name"] == "Sunday   " and padded["month_name"] == "March    "


def test_reference_day_is_clamped_into_the_month(spark):
    day = lambda m, as_of: dates.reference_day(F.lit(D(m)), F.lit(D(as_of)))
    r = one(
        spark,
        inside=day("2026-03-01", "2026-03-10"),
        past=day("2026-02-01", "2026-03-10"),
        future=day("2026-05-01", "2026-03-10"),
    )
    assert tuple(r) == (D("2026-03-10"), D("2026-02-28"), D("2026-05-01"))


def test_local_date_crosses_midnight(spark):
    text = F.lit("2026-01-31 13:30:00")
    for zone in ("UTC", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        naive = dates.local_date(text.cast("timestamp_ntz"))
        instant = dates.local_date(F.to_timestamp(F.lit("2026-01-31T13:30:00Z")), source_tz=None)
        r = one(spark, naive=naive, instant=instant)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert tuple(r) == (D("2026-02-01"), D("2026-02-01"))


def test_percentages_round_half_up(spark):
    c = lambda x: F.lit(M(x))
    r = one(
        spark,
        up=money.pct(c("0.25"), c("200")),
        negative=money.pct(c("-0.25"), c("200")),
        plain=money.pct(c("900"), c("1000")),
        none=money.pct(c("5"), c("0")),
        unknown=money.ratio_pct(c("5"), c("0")),
    )
    assert tuple(r) == (0.1, -0.1, 90.0, 0.0, None)


def test_bands(spark):
    labels = ("over", "near", "ok")
    c = lambda x: F.lit(M(x))
    r = one(
        spark,
        over=money.band(c(101), c(100), labels),
        at=money.band(c(90), c(100), labels),
        at_exclusive=money.band(c(90), c(100), labels, inclusive=False),
        zero=money.band(c(0), c(0), labels),
        zero_exclusive=money.band(c(0), c(0), labels, inclusive=False),
        unknown=money.band(c(5), F.lit(None).cast("decimal(12,2)"), labels),
    )
    assert tuple(r) == ("over", "near", "ok", "near", "ok", "ok")


def test_category_types(spark):
    r = one(spark, **{t: money.category_type(F.lit(t)) for t in ("fixed", "variable", "income", "saving")})
    assert tuple(r) == ("expense", "expense", "income", "saving")


def test_failed_rules_ignore_unknown(spark):
    rules = {"positive": F.col("x") > 0, "small": F.col("x") < 10}
    df = spark.createDataFrame([(-1,), (20,), (5,), (None,)], "x int")
    assert [r[0] for r in df.select(failed_rules(rules)).collect()] == [["positive"], ["small"], [], []]


def test_seeds_are_linked_by_name(spark):
    seeds = seed_reference(spark)
    counts = {n: df.count() for n, df in seeds.items()}
    assert counts == {"types": 4, "categories": 22, "merchant_rules": 19}
    assert seeds["categories"].where("type_id is null").count() == 0
    assert seeds["merchant_rules"].where("category_id is null").count() == 0
    per_type = dict(rows(seeds["categories"].groupBy("type_id").count()))
    assert per_type == {"fixed": 6, "variable": 8, "income": 4, "saving": 4}


def test_conform_adds_missing_columns(spark):
    df = conform(spark.createDataFrame([("a", "1")], "account_id string, id string"), "transactions")
    assert dict(df.dtypes)["amount"] == "decimal(12,2)" and df.first()["source"] is None


def test_keys_are_required():
    with pytest.raises(ValueError):
        key_list([])
