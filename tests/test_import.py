import os
import re

import pytest

from pyspark.sql import functions as F

from coffer import plans
from coffer.operators import categorise, dedup_new, keyword_index, match_rules
from coffer.session import work_dir
from coffer.sources import expand_breakdown, parse_statement, read_statement, unpivot_sheet
from coffer.sources.statements import SOURCE_ORDER, typed_statement
from coffer.streaming import import_stream
from conftest import D, M, rows

RAW = "account_id string, source_line bigint, Date string, Amount string, Description string, Balance string"
RULE = "keyword string, category_id string, priority int"
LEDGER = "account_id string, transaction_date date, amount decimal(12,2), raw_description string"


def statement(spark, lines):
    return spark.createDataFrame(
        [("a", i + 2, *line, None)[:6] if len(line) == 3 else ("a", i + 2, *line) for i, line in enumerate(lines)], RAW
    )


def test_parsing_keeps_good_rows_and_explains_bad_ones(spark):
    ok, rejects = parse_statement(
        statement(
            spark,
            [("31/02/2026", "5", "x", "1"), ("1/6/2026", "abc", "x", "1"), (" 12/06/2026 ", "-1,234.50", " Coles ", "12,450.30"),
             ("1/6/2026", "5500.00", "PAY", " "), ("1/6/2026", "5", "x", "n/a"), ("2026-06-01", "", None, None)],
        )
    )
    assert rows(ok.orderBy("source_line"), "source_line", "transaction_date", "amount", "raw_description", "is_credit", "balance") == [
        (4, D("2026-06-12"), M(1234.5), "Coles", False, M(12450.3)),
        (5, D("2026-06-01"), M(5500), "PAY", True, None),
    ]
    assert rows(rejects, "source_line", "reasons") == [
        (2, ["bad date"]), (3, ["bad amount"]), (6, ["bad balance"]), (7, ["bad date", "bad amount", "no description"]),
    ]


def test_reading_files_with_a_byte_order_mark(spark, tmp_path):
    folder = tmp_path / "account_id=7"
    folder.mkdir()
    text = 'Date,Amount,Description,Balance\n12/06/2026,-88.70,"Woolworths, Sydney",10\n13/06/2026,5,PAY,\n'
    (folder / "s.csv").write_bytes(b"\xef\xbb\xbf" + text.encode())
    raw = read_statement(spark, str(tmp_path))
    ok, rejects = parse_statement(raw)
    assert rows(ok, "account_id", "source_line", "amount", "raw_description") == [
        (7, 2, M(88.7), "Woolworths, Sydney"), (7, 3, M(5), "PAY"),
    ]
    assert rejects.count() == 0


def write_files(base, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "w", encoding="utf-8", newline="") as file:
            file.write(text)


HEADER = "Date,Amount,Description,Balance\n"


def test_quotes_line_breaks_and_columns_by_name(spark, tmp_path):
    write_files(tmp_path, {"x/s.csv": 'Description,Extra,Date,Amount\n"JOE ""THE"" SHOP, SYD",1,1/6/2026,-5\n"two\nlines",2,2/6/2026,-6\n'})
    ok, rejects = parse_statement(read_statement(spark, str(tmp_path / "x")))
    assert rows(ok, "raw_description", "amount", "balance") == [('JOE "THE" SHOP, SYD', M(5), None), ("two\nlines", M(6), None)]
    assert rejects.count() == 0


def test_files_with_different_headers_are_refused(spark, tmp_path):
    write_files(tmp_path, {"x/a.csv": HEADER + "1/6/2026,-5,a,1\n", "x/b.csv": "Amount,Date,Description,Balance\n-5,1/6/2026,a,1\n"})
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_statement(spark, str(tmp_path / "x")).collect()


def test_the_first_file_wins_at_any_split_size(spark, tmp_path):
    line = "1/6/2026,{},same,\n"
    write_files(tmp_path, {"account_id=a/1.csv": HEADER + "2/6/2026,-1,other,\n" + line.format(-5),
                           "account_id=a/2.csv": HEADER + line.format(5) + "".join(f"3/6/2026,-{i},pad {i},\n" for i in range(1, 400))})
    rules = spark.createDataFrame([("same", "c", 1)], RULE)
    ledger = spark.createDataFrame([], LEDGER)
    for size in ("64", "1m"):
        with_size = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
        old = {k: spark.conf.get(k) for k in with_size}
        try:
            for k, v in with_size.items():
                spark.conf.set(k, v)
            done = plans.import_statement(read_statement(spark, str(tmp_path)), rules, ledger, "b", SOURCE_ORDER)
            assert rows(done.inserted, "payment_method") == [("card",)]
            assert rows(done.duplicates, F.substring_index("source_file", "/", -1)) == [("2.csv",)]
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)


RULES = [("COLES", "groceries", 10), ("uber", "transport", 5), ("UBER EATS", "dining", 5), ("GYM", "health", 3), ("b_", "odd", 1)]
TEXTS = ["Coles Uber", "UBER EATS sydney", "the gym", "nothing", "ab_c", "", "Über", "line\nuber\nbreak", None]
EXPECTED = {"Coles Uber": "groceries", "UBER EATS sydney": "dining", "the gym": "health", "nothing": None, "ab_c": "odd",
            "": None, "Über": None, "line\nuber\nbreak": "transport", None: None}


def texts(spark, values=TEXTS):
    return spark.createDataFrame([("a", t) for t in values], "account_id string, raw_description string")


def categories(df):
    return {r["raw_description"]: r["category_id"] for r in df.collect()}


def test_rules_inline_and_by_join_agree(spark):
    rules = spark.createDataFrame(RULES, RULE)
    # 'UBER EATS' sorts before 'uber', so it wins among equal priorities
    assert categories(categorise(texts(spark), rules, inline=True)) == EXPECTED
    assert categories(categorise(texts(spark), rules)) == EXPECTED


def test_rule_join_equals_brute_force(spark):
    words = ["", "a", "ab", "abc", "bca", "cab", "aab", "bb", "😀", "x😀y", "ca b"]
    rules = [(w, f"c{i}", i % 3) for i, w in enumerate(words[1:])]
    sample = [a + b + c for a in words for b in words for c in words[:4]]
    def best(text):
        hits = [(-p, k, c) for k, c, p in rules if k.upper() in text.upper()]
        return min(hits)[2] if hits else None
    df = categorise(texts(spark, sample), spark.createDataFrame(rules, RULE))
    assert categories(df) == {t: best(t) for t in sample}


def test_empty_keyword_matches_everything_and_no_rules_nothing(spark):
    every = spark.createDataFrame([("", "any", 0)], RULE)
    for inline in (False, True):
        assert categories(categorise(texts(spark, ["x", ""]), every, inline=inline)) == {"x": "any", "": "any"}
        assert categories(categorise(texts(spark, ["x"]), every.limit(0), inline=inline)) == {"x": None}


def test_any_number_of_long_keywords_with_equal_starts(spark):
    words = [f"{a}{b}{c}{d}" for a in ("alpha", "alpine") for b in "xyz" for c in "uvw" for d in range(12)]
    df = texts(spark, [f"to {w} and {v}" for w, v in zip(words, words[7:])])
    for n in (3, 200, 201):
        rules = spark.createDataFrame([(w, w, 1) for w in words[:n]], RULE)
        got = categories(categorise(df, rules))
        assert got == {t: min((w for w in words[:n] if w in t), default=None) for t in got}
    joined = match_rules(df, spark.createDataFrame([(w, w, 1) for w in words], RULE), "raw_description")
    assert joined.count() == df.count()


def test_rules_per_ledger(spark):
    rules = spark.createDataFrame([("b", "coles", "b-cat", 1), ("a", "coles", "a-cat", 1)], "account_id string, " + RULE)
    df = spark.createDataFrame([("a", "COLES"), ("b", "COLES"), ("c", "COLES")], "account_id string, raw_description string")
    assert rows(categorise(df, rules), "account_id", "category_id") == [("a", "a-cat"), ("b", "b-cat"), ("c", None)]
    assert match_rules(df, rules, "raw_description").count() == 2


def run_import(spark, lines, ledger=()):
    return plans.import_statement(
        statement(spark, lines),
        spark.createDataFrame(RULES, RULE),
        spark.createDataFrame([("a", D(d), M(x), t) for d, x, t in ledger], LEDGER),
        "20260601_bank",
    )


def test_import_accounts_for_every_row(spark):
    done = run_import(
        spark,
        [("1/6/2026", "-50", "Coles"), ("1/6/2026", "50", "Coles"), ("2/6/2026", "-9", "gym"), ("2/6/2026", "-9", "mystery"),
         ("2/6/2026", "-9", "mystery"), ("3/6/2026", "0", "gym"), ("bad", "1", "gym"), ("4/6/2026", "7", "old mystery"),
         ("5/6/2026", "70", "uber"), ("6/6/2026", "1", "gym " + "x" * 252)],
        [("2026-06-02", 9, "gym"), ("2026-06-04", 7, "old mystery"), ("2026-06-05", 70, None)],
    )
    assert rows(done.inserted, "source_line", "category_id", "payment_method", "source", "import_batch_id") == [
        (10, "transport", "transfer", "bank_import", "20260601_bank"), (2, "groceries", "card", "bank_import", "20260601_bank"),
    ]
    assert rows(done.duplicates, "source_line") == [(3,), (4,), (9,)]
    assert rows(done.review, "source_line") == [(5,), (6,)]
    assert rows(done.rejects, "source_line", "reasons") == [
        (11, ["raw_description too long"]), (7, ["amount must be positive"]), (8, ["bad date"]),
    ]
    assert rows(done.summary) == [("a", 4, 3, 2, 5, 3)]


def test_importing_again_changes_nothing(spark):
    lines = [("1/6/2026", "-50", "Coles"), ("1/6/2026", "-51", "Coles"), ("1/6/2026", "-51", "Coles")]
    first = run_import(spark, lines).inserted
    ledger = [(r["transaction_date"].isoformat(), r["amount"], r["raw_description"]) for r in first.collect()]
    again = run_import(spark, lines, ledger)
    assert len(ledger) == 2 and again.inserted.count() == 0 and again.duplicates.count() == 3


def test_first_occurrence_wins(spark):
    batch = spark.createDataFrame(
        [("a", i, D("2026-06-01"), M(5), t, i * 1.0) for i, t in enumerate(["x", "x", "y", "x"])],
        "account_id string, source_line int, transaction_date date, amount decimal(12,2), raw_description string, extra double",
    )
    ledger = spark.createDataFrame([("a", D("2026-06-01"), M(5), "y"), ("b", D("2026-06-01"), M(5), "x")], LEDGER)
    assert rows(dedup_new(batch, ledger), "source_line", "extra") == [(0, 0.0)]


def test_stream_imports_new_files_once(spark):
    base = work_dir(spark, "stream")
    rules = spark.createDataFrame(RULES, RULE)
    ledger = spark.createDataFrame([("a", D("2026-06-03"), M(7), "uber home"), ("b", D("2026-06-01"), M(50), "Coles")], LEDGER)

    def run(checkpoint):
        import_stream(spark, f"{base}/in", f"{base}/ledger", f"{base}/{checkpoint}", rules, ledger).awaitTermination()
        return rows(spark.read.parquet(f"{base}/ledger"), "account_id", "transaction_date", "amount", "category_id", "source")

    def report(name, *columns):
        return rows(spark.read.parquet(f"{base}/ledger-reports/{name}"), *columns)

    write_files(base, {"in/account_id=a/1.csv": HEADER + '1/6/2026,-50,Coles,\n2/6/2026,-9,"gym, ""the"" one",10\n2/6/2026,-9,mystery,\n'
                       "3/6/2026,-7,uber home,\nbad,-1,gym,\n"})
    first = [("a", D("2026-06-01"), M(50), "groceries", "bank_import"), ("a", D("2026-06-02"), M(9), "health", "bank_import")]
    assert run("checkpoint") == first
    assert report("review", "raw_description") == [("mystery",)] and report("duplicates", "raw_description") == [("uber home",)]
    assert report("rejects", "account_id", "source_line", "reasons") == [("a", 6, ["bad date"])]
    assert report("summary", "matched", "unknown", "inserted", "skipped", "rejected") == [(3, 1, 2, 2, 1)]
    assert run("checkpoint") == first
    write_files(base, {"in/account_id=a/2.csv": HEADER + '2/6/2026,-9,"gym, ""the"" one",10\n1/1/2020,-3,uber late,\n'})
    after = run("checkpoint")
    assert after == sorted([*first, ("a", D("2020-01-01"), M(3), "transport", "bank_import")], key=repr)
    folders = [f for f in os.listdir(f"{base}/ledger") if f.startswith("import_batch_id=")]
    assert len({f.split("=")[1].rsplit("_", 1)[0] for f in folders}) == 1 and "None" not in "".join(folders)
    assert sorted(f for x in folders for f in os.listdir(f"{base}/ledger/{x}") if f.startswith("year")) == ["year_month=2020-01", "year_month=2026-06"]
    assert run("fresh-checkpoint") == after


MAPPING = [("Pay", "Salary", "2026-03-16", "Monthly salary"), ("Gym", "Health", "2026-03-16", "Gym membership"),
           ("Uber", "Transport", "2026-03-27", "Uber ride"), ("Yacht", "Boats", "2026-03-27", "Yacht"), ("Fuel", "Transport", "2026-03-28", "Fuel")]


def test_sheet_cells_become_transactions(spark, dims):
    sheet = spark.createDataFrame(
        [("a", 6760.0, 30.5, 0.0, 12.0, None, 1.0)],
        "account_id string, Pay double, Gym double, Uber double, Yacht double, Fuel double, Unmapped double",
    )
    mapping = spark.createDataFrame(
        [(c, k, D(d), t) for c, k, d, t in MAPPING], "column string, category string, date date, description string"
    )
    ok, warnings = unpivot_sheet(sheet, ["account_id"], mapping, dims["categories"])
    assert rows(ok, "transaction_date", "category_id", "amount", "description") == [
        (D("2026-03-16"), "health", M(30.5), "Gym membership"), (D("2026-03-16"), "salary", M(6760), "Monthly salary"),
    ]
    assert rows(warnings, "column", "message") == [("Yacht", "Category 'Boats' not found, skipping Yacht")]
    assert rows(plans.sheet_balance(ok, dims["categories"], "Salary", ["account_id"])) == [("a", M(6760), M(30.5), 2, M(6729.5))]


def test_sheets_with_categories_per_ledger(spark):
    sheet = spark.createDataFrame([("a", 5.0), ("b", 6.0), ("c", 7.0)], "account_id string, Gym double")
    mapping = spark.createDataFrame([("Gym", "Health", D("2026-03-16"), "x")], "column string, category string, date date, description string")
    categories = spark.createDataFrame(
        [("a", "a1", "Health"), ("a", "a2", "Health"), ("b", "b1", "Health")], "account_id string, id string, name string"
    )
    ok, warnings = unpivot_sheet(sheet, ["account_id"], mapping, categories)
    assert rows(ok, "account_id", "category_id") == [("a", "a1"), ("b", "b1")] and rows(warnings, "account_id") == [("c",)]
    assert rows(plans.sheet_balance(ok, categories, "Health", ["account_id"]), "account_id", "income") == [("a", M(5)), ("b", M(6))]


def test_envelopes_with_types_per_ledger(spark):
    budget = "account_id string, {} string, year_month date, budget_amount decimal(12,2)"
    monthly = spark.createDataFrame([("a", "rent", D("2026-01-01"), M(1))], budget.format("category_id"))
    group_monthly = spark.createDataFrame([("a", "g", D("2026-01-01"), M(2)), ("b", "g", D("2026-01-01"), M(3))], budget.format("expense_group_id"))
    cats = spark.createDataFrame([("a", "rent", "a-fixed")], "account_id string, id string, type_id string")
    groups = spark.createDataFrame([("g", "fixed")], "id string, name string")
    types = spark.createDataFrame([("a", "a-fixed", "fixed"), ("b", "b-fixed", "fixed")], "account_id string, id string, name string")
    done = plans.unify_budgets(monthly, group_monthly, cats, groups, types)
    assert rows(done.budgets, "account_id", "type_id", "category_id", "budget_amount") == [
        ("a", "a-fixed", "rent", M(1)), ("a", "a-fixed", None, M(2)), ("b", "b-fixed", None, M(3)),
    ]
    assert done.checks.where("violations > 0").count() == 0


def test_breakdowns_are_reconciled_and_expanded(spark, dims):
    parts = spark.createDataFrame(
        [("EVERYDAY", "Groceries", M(300)), ("EVERYDAY", "Boats", M(265.8)), ("JOINT", "Shopping", M(40)), ("OFF", "Shopping", M(5)), ("X", "Rent", M(1))],
        "label string, category string, amount decimal(12,2)",
    ).withColumn("transaction_date", F.lit(D("2026-03-20"))).withColumn("description", F.lit("x"))
    totals = spark.createDataFrame(
        [("EVERYDAY", M(565.8)), ("JOINT", M(40.02)), ("OFF", M(0)), ("NIL", None), ("MISS", M(3)), ("X", M(1.01))],
        "label string, stated_total decimal(12,2)",
    )
    assert rows(plans.reconcile(parts, totals, ["label"]), "label", "difference", "matches") == [
        ("EVERYDAY", M(0), True), ("JOINT", M(0.02), False), ("MISS", M(3), False), ("X", M(0.01), True),
    ]
    ok, warnings = expand_breakdown(parts, totals, dims["categories"], ["label"])
    assert rows(ok, "label", "category_id") == [("EVERYDAY", "groceries"), ("JOINT", "shopping"), ("X", "rent")]
    assert rows(warnings, "label", "category") == [("EVERYDAY", "Boats")]


@pytest.mark.parametrize("inline", [False, True])
def test_rules_have_one_meaning_inline_and_by_join(spark, inline):
    rules = spark.createDataFrame(
        [("shop", None, 90), ("shop", "b", 50), ("shop", "a", 50), ("sho", "weak", None)], RULE
    )
    df = categorise(texts(spark, ["a shop", "shore"]), rules, inline=inline)
    assert categories(df) == {"a shop": "a", "shore": "weak"}


def plan_text(df):
    """The physical plan with whole paths and filters."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 4000)
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


def scans(df, path):
    """Times that a plan reads files below a path."""
    return len(re.findall(rf"FileScan [^\n]*{re.escape(path)}", plan_text(df)))


def test_outputs_of_kept_rows_repeat_no_work(spark):
    base = work_dir(spark, "import")
    lines = [("1/6/2026", "-50", "Coles"), ("1/6/2026", "-50", "Coles"), ("2/6/2026", "-9", "mystery"), ("3/6/2026", "0", "gym"), ("4/6/2026", "7", "gym")]
    statement(spark, lines).write.parquet(f"{base}/lines")
    spark.createDataFrame([("a", D("2026-06-04"), M(7), "gym")], LEDGER).write.parquet(f"{base}/ledger")
    raw, ledger = (spark.read.parquet(f"{base}/{t}") for t in ("lines", "ledger"))
    index = keyword_index(spark.createDataFrame(RULES, RULE))
    done = plans.import_statement(raw, spark.createDataFrame(RULES, RULE), ledger, "b", index=index)
    assert scans(done.rows, f"{base}/ledger") == 1
    # the keyword join, and what it looks up about the index
    assert len(re.findall(r"Join [^\n]*_gram", done.rows._jdf.queryExecution().executedPlan().toString())) == 1
    kept = plans.outputs(done.rows.persist(), "b")
    for name in ("inserted", "duplicates", "review", "rejects", "summary"):
        text = getattr(kept, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in text and not text.split("InMemoryRelation")[0].count("Join")
        assert rows(getattr(kept, name)) == rows(getattr(done, name))
    assert rows(done.rows, "source_line", "outcome") == [(2, "inserted"), (3, "duplicates"), (4, "review"), (5, "rejects"), (6, "duplicates")]
    assert rows(kept.summary) == [("a", 3, 1, 1, 3, 1)]
    done.rows.unpersist()


def test_rows_without_a_ledger_are_rejected(spark):
    raw = statement(spark, [("1/6/2026", "-50", "Coles")] * 2).withColumn("account_id", F.when(F.col("source_line") == 2, "a"))
    done = plans.import_statement(raw, spark.createDataFrame(RULES, RULE), spark.createDataFrame([], LEDGER), "b")
    assert rows(done.inserted, "account_id", "source_line") == [("a", 2)]
    assert rows(done.rejects, "account_id", "source_line", "reasons") == [(None, 3, ["account_id is required"])]


def test_a_stray_date_reads_its_month_alone(spark, monkeypatch):
    from coffer.streaming import statement_stream

    base = work_dir(spark, "stray")
    rules, read = spark.createDataFrame(RULES, RULE), []
    run = lambda: import_stream(spark, f"{base}/in", f"{base}/ledger", f"{base}/checkpoint", rules).awaitTermination()
    write_files(base, {"in/account_id=a/1.csv": HEADER + "".join(f"3/{m}/2026,-{m},gym {m},\n" for m in range(1, 13)) + "1/1/1970,-1,gym,\n"})
    run()
    original = statement_stream.import_statement

    def watched(lines, rules, known, *args):
        read.append(plan_text(known))
        return original(lines, rules, known, *args)

    monkeypatch.setattr(statement_stream, "import_statement", watched)
    write_files(base, {"in/account_id=a/2.csv": HEADER + "3/6/2026,-6,gym 6,\n1/1/1970,-1,gym,\n5/6/2026,-5,gym,\n"})
    run()
    folders = re.findall(r"PartitionFilters: \[[^\]]*year_month#\d+ IN \(([^)]*)\)", read[-1])
    assert folders and {frozenset(f.split(",")) for f in folders} == {frozenset(["1970-01", "2026-06"])}
    got = spark.read.parquet(f"{base}/ledger")
    assert got.count() == 14 and got.where("transaction_date = '2026-06-05'").count() == 1


def test_statement_and_ledger_are_parsed_and_shuffled_once(spark):
    base = work_dir(spark, "import")
    lines = [("1/6/2026", "-50", "Coles"), ("1/6/2026", "-50", "Coles"), ("x", "-9", "gym"), ("3/6/2026", "7", "gym")]
    statement(spark, lines).write.parquet(f"{base}/lines")
    spark.createDataFrame([("a", D("2026-06-03"), M(7), "gym"), ("a", D("2020-01-01"), M(7), "gym")], LEDGER).write.parquet(f"{base}/ledger")
    raw, ledger = (spark.read.parquet(f"{base}/{t}") for t in ("lines", "ledger"))
    done = plans.import_statement(raw, spark.createDataFrame(RULES, RULE), ledger, "b", inline_rules=True)
    text = plan_text(done.summary)
    assert text.count("Amount:string") == 1 and scans(done.summary, f"{base}/ledger") == 1 and "Join" not in text
    assert plan_text(done.duplicates).count("Amount:string") == 2
    for df in (done.summary, done.duplicates):  # the text is parsed in no filter
        assert not re.search(r"(Filter|Join) [^\n]*gettimestamp", plan_text(df))
    assert rows(done.summary) == [("a", 3, 0, 1, 2, 1)]
    assert rows(done.duplicates, "source_line") == [(3,), (5,)]


def test_rows_of_one_file_are_spread_over_tasks(spark, monkeypatch):
    from coffer.streaming import statement_stream

    base, seen = work_dir(spark, "spread"), []
    original = statement_stream.import_statement
    monkeypatch.setattr(statement_stream, "import_statement", lambda lines, *a: seen.append(plan_text(lines)) or original(lines, *a))
    write_files(base, {"in/account_id=a/1.csv": HEADER + "".join(f"3/{m}/2026,-{m},gym {m},\n" for m in range(1, 13))})
    import_stream(spark, f"{base}/in", f"{base}/ledger", f"{base}/checkpoint", spark.createDataFrame(RULES, RULE)).awaitTermination()
    assert "RoundRobinPartitioning" in seen[0] and spark.read.parquet(f"{base}/ledger").count() == 12


def test_a_batch_is_parsed_once_and_meets_its_own_ledgers(spark, monkeypatch):
    from coffer.streaming import statement_stream

    base, seen = work_dir(spark, "own"), []
    original = statement_stream.import_statement

    def watched(lines, rules, known, *args):
        seen.append((set(lines.columns), plan_text(lines), rows(known, "account_id")))
        return original(lines, rules, known, *args)

    monkeypatch.setattr(statement_stream, "import_statement", watched)
    ledger = spark.createDataFrame([(a, D("2026-03-01"), M(1), "gym 1") for a in ("a", "b", "b", None)], LEDGER)
    lines = "3/3/2026,-3,gym 3,\n1/3/2026,-1,gym 1,\n1/3/2026,-1,gym 1,\nx,-1,gym 1,\n"
    write_files(base, {f"in/account_id={a}/1.csv": HEADER + lines for a in ("a", "c")})
    rules = spark.createDataFrame(RULES, RULE)
    for few in (1000, 1):
        monkeypatch.setattr(statement_stream, "_FEW", few)
        run = f"{base}/{few}"
        import_stream(spark, f"{base}/in", f"{run}/ledger", f"{run}/checkpoint", rules, ledger).awaitTermination()
        assert rows(spark.read.parquet(f"{run}/ledger"), "account_id", "raw_description") == [("a", "gym 3"), ("c", "gym 1"), ("c", "gym 3")]
        found = lambda name: rows(spark.read.parquet(f"{run}/ledger-reports/{name}"), "account_id", "source_line")
        assert [len(found(n)) for n in ("duplicates", "review", "rejects")] == [3, 0, 2]
        assert rows(spark.read.parquet(f"{run}/ledger-reports/summary").drop("import_batch_id")) == [("a", 3, 0, 1, 2, 1), ("c", 3, 0, 2, 1, 1)]
    assert all("transaction_date" in columns and "Date" not in columns for columns, _, _ in seen)
    assert all("RoundRobinPartitioning" in text for _, text, _ in seen)
    assert [known for _, _, known in seen] == [[("a",)], [("a",), ("b",), ("b",), (None,)]]


def test_typed_lines_import_like_their_text(spark):
    lines = [("1/6/2026", "-50", "Coles"), ("1/6/2026", "-50", "Coles"), ("x", "-9", "gym"), ("3/6/2026", "7", "gym"), ("3/6/2026", "0", "gym"), ("4/6/2026", "-7", "?")]
    raw = statement(spark, lines)
    ledger = spark.createDataFrame([("a", D("2026-06-03"), M(7), "gym")], LEDGER)
    of = lambda given: plans.import_statement(given, spark.createDataFrame(RULES, RULE), ledger, "b")
    for text, typed in zip(of(raw), of(typed_statement(raw))):
        assert rows(text) == rows(typed) and rows(text)
