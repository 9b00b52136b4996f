"""Hot keys: one ledger, day, text or group of copies holds most rows."""

import random
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from coffer import plans
from coffer.operators import assign_periods, dedup_new, keyword_index, known_keys, match_rules, pay_periods, rule_candidates
from coffer.keys import spread_join
from coffer.sources import date_dim, write_ledger
from conftest import D, M, pay_dates, rows, txns

# settings that make adaptive execution treat a few hundred rows as a skewed partition
SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_SKEW}
    for k, v in SMALL_SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot_ledger(spark, n=6000):
    """Two thirds of the rows are one account's on one day."""
    day = F.when(F.col("id") % 3 > 0, F.lit(D("2026-03-15"))).otherwise(
        F.date_add(F.lit(D("2026-01-01")), (F.col("id") % 150).cast("int"))
    )
    account = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("a"), F.col("id") % 40))
    return spark.range(0, n, 1, 12).select(
        account.alias("account_id"),
        F.concat(F.lit("t"), "id").alias("id"),
        day.alias("transaction_date"),
        F.lit("rent").alias("category_id"),
        F.lit(M(1)).alias("amount"),
        F.sha2(F.col("id").cast("string"), 512).alias("description"),
    )


def test_hot_day_is_split_when_periods_are_assigned(tight):
    ledger = hot_ledger(tight)
    periods = pay_periods(
        tight.createDataFrame([("hot", D("2026-02-01")), ("hot", D("2026-03-01")), ("a3", D("2026-02-01"))], "account_id string, pay_date date")
    )
    df = assign_periods(ledger, periods)
    assert "skew=true" in final_plan(df)
    by_range = assign_periods(ledger, periods, method="range")
    columns = ("id", "pay_period_start", "pay_period_end")
    assert rows(df, *columns) == rows(by_range, *columns)


def test_hot_group_of_copies_is_split_in_the_import(tight):
    line = F.when(F.col("id") % 3 > 0, F.lit("coles hot")).otherwise(F.concat(F.lit("coles "), "id"))
    raw = tight.range(0, 6000, 1, 12).select(
        F.lit("a").alias("account_id"), F.col("id").alias("source_line"), F.lit("1/6/2026").alias("Date"),
        F.lit("-5").alias("Amount"), line.alias("Description"), F.col("id").cast("string").alias("Balance"),
    )
    rules = tight.createDataFrame([("COLES", "groceries", 1)], "keyword string, category_id string, priority int")
    ledger = tight.createDataFrame([("a", D("2026-06-01"), M(5), "coles 3")], "account_id string, transaction_date date, amount decimal(12,2), raw_description string")
    done = plans.import_statement(raw, rules, ledger, "b")
    assert "skew=true" in final_plan(done.duplicates)
    assert rows(done.summary) == [("a", 6000, 0, 2000, 4000, 0)]
    inserted = {r["source_line"] for r in done.inserted.collect()}
    assert inserted == {1} | {i for i in range(6000) if i % 3 == 0} - {3}
    assert {r["source_line"] for r in done.duplicates.collect()} == set(range(6000)) - inserted


def test_hot_ledger_key_is_split_when_known_rows_are_looked_up(tight):
    key = F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id"))
    target, batch = tight.range(0, 6000, 1, 12).select(key.alias("k")), tight.range(-1, 50).select(F.col("id").alias("k"))
    df = known_keys(batch, target, ["k"])
    assert "skew=true" in final_plan(df)
    assert rows(df) == sorted([(-1,), *((i,) for i in range(0, 50, 3))], key=repr)


def test_spread_join_matches_keys_of_different_types(spark):
    left = spark.sql("SELECT CAST(id AS INT) AS k, CAST(id AS DECIMAL(10,1)) AS d FROM range(5)")
    right = spark.sql("SELECT id AS k, CAST(id AS DECIMAL(12,3)) AS d FROM range(3, 9)")
    assert rows(spread_join(left, right, ["k", "d"], "left_semi"), "k") == [(3,), (4,)]
    assert spread_join(left, right, ["k", "d"], "left_anti").count() == 3


def test_copies_collapse_before_the_exchange(spark):
    batch = spark.range(0, 5000, 1, 8).select(
        F.lit("a").alias("account_id"), F.col("id").alias("source_line"), F.lit(D("2026-06-01")).alias("transaction_date"),
        F.lit(M(5)).alias("amount"), F.lit("same").alias("raw_description"),
    )
    ledger = spark.createDataFrame([], "account_id string, transaction_date date, amount decimal(12,2), raw_description string")
    df = dedup_new(batch, ledger)
    assert rows(df, "source_line") == [(0,)]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_marts_under_a_hot_account_equal_the_plain_computation(spark, dims):
    ledger = hot_ledger(spark)
    staged = plans.stage_daily(ledger, date_dim(spark), pay_periods(pay_dates(spark, ["2026-02-01", "2026-03-01"], "hot")))
    stg_c = dims["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.lit("expense").alias("category_type"), F.lit("fixed").alias("type_name"))
    pps = plans.fct_pay_period_summary(staged, stg_c)
    assert rows(pps.where("account_id = 'hot'"), "period_label", "transaction_count") == [("2026-03-01", 4000)]
    assert pps.agg(F.sum("total_amount")).first()[0] == M(6000)


def test_long_texts_are_searched_to_the_end(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh ") for _ in range(50)) for _ in range(400)]
    long_text = " ".join(words) + " needle"
    df = spark.createDataFrame([(long_text,), ("none",)], "text string")
    rules = spark.createDataFrame([("NEEDLE", "found", 1), ("needles", "no", 9)], "keyword string, category_id string, priority int")
    assert rows(match_rules(df, rules, "text"), "category_id") == [("found",)]


def test_month_folders_are_read_alone(spark, tmp_path):
    data = [((date(2026, 1, 1) + timedelta(days=i)).isoformat(), "rent", 1) for i in range(90)]
    write_ledger(txns(spark, data), str(tmp_path / "ledger"))
    back = spark.read.parquet(str(tmp_path / "ledger"))
    assert back.count() == 90
    text = back.where("year_month = '2026-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in text and back.where("year_month = '2026-02'").count() == 28


def distinct_candidates(df, index):
    return rule_candidates(df, index, "text").select("_hash", "_keyword").distinct().count()


@pytest.mark.parametrize("keyword, n_rules", [("TRANSFER TO CUSTOMER %06d", 100_000), ("PAYPAL *%06d SYDNEY AU", 20_000), ("%06d DIRECT DEBIT OF THE BANK", 20_000)])
def test_many_rules_that_begin_or_end_alike_cost_a_text_few_candidates(spark, keyword, n_rules):
    ids = spark.range(n_rules).select((F.col("id") * 9973 % (10 * n_rules)).alias("n"))
    name = lambda n: F.format_string(keyword, n)
    rules = ids.select(name(F.col("n")).alias("keyword"), F.col("n").cast("string").alias("category_id"), F.lit(1).alias("priority"))
    df = ids.where("n % 10 = 0").select(F.concat(F.lit("ref 17 "), name(F.col("n")), F.lit(" on card")).alias("text"), F.col("n").cast("string").alias("want"))
    index = keyword_index(rules, df, "text")
    hits = match_rules(df, rules, "text", index=index).join(df, "text")
    n = df.count()
    assert n == n_rules // 10 and hits.where("category_id = want").count() == hits.count() == n
    assert distinct_candidates(df, index) <= 2 * n


def test_texts_that_begin_alike_are_no_candidates_of_one_rule(spark):
    df = spark.range(5000).select(F.format_string("PAYPAL *SHOP %05d", F.col("id")).alias("text"))
    rules = spark.createDataFrame([("paypal *shop 00017", "one", 1), ("paypal *gym", "none", 1)], "keyword string, category_id string, priority int")
    index = keyword_index(rules, df, "text")
    assert rows(match_rules(df, rules, "text", index=index), "text") == [("PAYPAL *SHOP 00017",)]
    assert distinct_candidates(df, index) <= 2


def test_an_index_serves_other_texts_and_a_hot_gram_is_split(spark):
    rules = spark.createDataFrame([("transfer", "t", 1), ("transfer out", "o", 2), ("x", "x", 0), ("漢字です", "k", 9)], "keyword string, category_id string, priority int")
    index = keyword_index(rules)
    df = spark.range(3000).select(F.concat(F.lit("transfer "), F.when(F.col("id") % 3 == 0, "out ").otherwise("in "), F.col("id").cast("string")).alias("text"))
    odd = spark.createDataFrame([("ab漢字です",), ("漢字で",), ("x",), ("",), (None,)], "text string")
    got = match_rules(df.unionByName(odd), rules, "text", index=index).groupBy("category_id").count()
    assert rows(got) == [("k", 1), ("o", 1000), ("t", 2000), ("x", 1)]
    assert match_rules(odd.where("text is null"), rules, "text", index=index).count() == 0


def test_few_keywords_are_filed_whole_and_match_alike(spark, monkeypatch):
    from coffer.operators import categorise

    module = sys.modules["coffer.operators.categorise"]
    words = ["", "a", "red", "salmon pink", "almond antique", "N A", "é"]
    rules = spark.createDataFrame([(w, w or "all", len(w)) for w in words], "keyword string, category_id string, priority int")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Salmon Pink", "an antique", "xRedx", "É", "", "\n a", None, "almond antique red"])], "id int, text string")
    index = keyword_index(rules, df, "text")
    assert rows(index, "_keyword", "_gram") == sorted([(w.upper(), w.upper()) for w in words], key=repr)
    whole = rows(categorise(df, rules, "text"), "id", "category_id")
    monkeypatch.setattr(module, "_FEW", 0)
    assert rows(categorise(df, rules, "text"), "id", "category_id") == whole
    assert rows(categorise(df, rules, "text", inline=True), "id", "category_id") == whole
