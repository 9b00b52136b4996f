"""The queries of ``workload/queries.py`` in DuckDB SQL, written independently of the library:
range joins instead of as-of windows, a recursive walk instead of a fold, whole-cent integer
arithmetic instead of decimal rounding."""

from __future__ import annotations

from workload.mapping import BUDGET_ROWS, CATEGORY_ROWS, RULE_ROWS, SHEET_MAPPING, TYPE_ROWS

ACTIVE = "DATE '2030-01-01'"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if hasattr(value, "isoformat"):
        return f"DATE '{value.isoformat()}'"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)


def pct(num: str, den: str, else_: str = "0") -> str:
    """Percent with one decimal, half up, from whole cents."""
    x, b = f"CAST(({num}) * 100 AS HUGEINT)", f"CAST(({den}) * 100 AS HUGEINT)"
    return (
        f"CAST(CASE WHEN {den} > 0 THEN sign({x}) * ((abs({x}) * 2000 + {b}) // (2 * {b})) / 10.0 "
        f"ELSE {else_} END AS DOUBLE)"
    )


def pct0(num: str, den: str) -> str:
    x, b = f"CAST(({num}) * 100 AS HUGEINT)", f"CAST(({den}) * 100 AS HUGEINT)"
    return f"CAST(CASE WHEN {den} > 0 THEN (abs({x}) * 200 + {b}) // (2 * {b}) ELSE 0 END AS DOUBLE)"


def money(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(18,2))"


def total_if(condition: str, value: str = "amount") -> str:
    return money(f"COALESCE(SUM({value}) FILTER (WHERE {condition}), 0)")


# name -> (names of the relations it reads, SQL)
RELATIONS: dict[str, tuple[str, str]] = {
    "types": ("", f"SELECT * FROM (VALUES {_values((n, n, o) for n, o in TYPE_ROWS)}) v(id, name, sort_order)"),
    "cats": (
        "",
        "SELECT id, name, type_id, CASE WHEN type_id IN ('income','saving') THEN type_id ELSE 'expense' END AS kind "
        f"FROM (VALUES {_values(CATEGORY_ROWS)}) v(id, name, type_id)",
    ),
    "txns": (
        "",
        """SELECT o_orderkey AS id, c_nationkey AS account_id, CAST(o_orderdate AS DATE) AS transaction_date,
        o_orderpriority AS category_id, CASE WHEN o_orderpriority = '5-LOW' THEN o_custkey END AS savings_goal_id,
        CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
        CASE WHEN o_orderstatus <> 'P' THEN 'Order ' || o_orderkey END AS description,
        CASE o_orderstatus WHEN 'F' THEN 'card' WHEN 'O' THEN 'transfer' ELSE 'direct_debit' END AS payment_method,
        o_orderkey % 7 = 0 AS is_recurring, 'manual' AS source
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    ),
    "ctxns": (
        "",
        """SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS transaction_date,
        o_orderpriority AS category_id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount FROM orders""",
    ),
    "budgets": (
        "",
        "SELECT n_nationkey AS account_id, CAST(n_nationkey * 10 + slot AS BIGINT) AS id, type_id, category_id, start_date, "
        "end_date, CAST(base + step * n_nationkey AS DECIMAL(12,2)) AS budget_amount FROM nation, "
        f"(VALUES {_values(BUDGET_ROWS)}) v(slot, type_id, category_id, start_date, end_date, base, step)",
    ),
    "cbudgets": (
        "",
        """SELECT c_custkey AS account_id, c_custkey * 10 + slot AS id, type_id, category_id, start_date, end_date,
        CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) * factor + plus AS DECIMAL(12,2)) AS budget_amount
        FROM customer, (VALUES (1, 'fixed', '2-HIGH', DATE '1995-01-01', DATE '1998-01-01', 1, 0),
        (2, 'fixed', '2-HIGH', DATE '1998-01-01', DATE '2030-01-01', 1, 500),
        (3, 'variable', NULL, DATE '1996-01-01', DATE '2030-01-01', 2, 0))
        v(slot, type_id, category_id, start_date, end_date, factor, plus)""",
    ),
    "changes": (
        "",
        """SELECT c_custkey AS account_id, c_custkey * 10 + slot AS id, type_id, category_id,
        CASE WHEN slot = 9 AND c_custkey % 17 = 0 THEN DATE '2030-01-01' ELSE DATE '2001-02-01' END AS start_date,
        CAST(CASE slot WHEN 6 THEN CASE WHEN c_custkey % 3 = 0 THEN bal + 500 WHEN c_custkey % 13 = 1 THEN -1 ELSE bal + 700 END
        WHEN 7 THEN bal * 3 WHEN 8 THEN bal * 4 ELSE bal END AS DECIMAL(12,2)) AS budget_amount
        FROM (SELECT c_custkey, abs(CAST(c_acctbal AS DECIMAL(12,2))) AS bal FROM customer),
        (VALUES (6, 'fixed', '2-HIGH'), (7, 'variable', NULL), (8, 'variable', NULL), (9, 'saving', '5-LOW')) v(slot, type_id, category_id)
        WHERE slot <> 8 OR c_custkey % 11 = 0""",
    ),
    "goals": (
        "",
        """SELECT c_custkey AS id, c_nationkey AS account_id, c_name AS name,
        CAST((c_custkey % 9 + 1) * 1000 AS DECIMAL(12,2)) AS target_amount,
        CAST(greatest(CAST(c_acctbal AS DECIMAL(12,2)), 0) AS DECIMAL(12,2)) AS current_amount,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'completed' WHEN 'MACHINERY' THEN 'paused' ELSE 'active' END AS status
        FROM customer""",
    ),
    "acats": (
        "cats",
        """SELECT DISTINCT o_custkey AS account_id, cats.id, cats.name, cats.type_id, cats.kind
        FROM orders JOIN cats ON cats.id = o_orderpriority""",
    ),
    "walk": (
        "txns",
        """SELECT account_id, min(transaction_date) AS d FROM txns
        WHERE category_id = '1-URGENT' AND amount >= 300000 GROUP BY account_id
        UNION ALL
        SELECT w.account_id, min(t.transaction_date) FROM walk w JOIN txns t ON t.account_id = w.account_id
        WHERE t.category_id = '1-URGENT' AND t.amount >= 300000 AND t.transaction_date > w.d + 7 GROUP BY w.account_id""",
    ),
    "cwalk": (
        "ctxns",
        """SELECT account_id, min(transaction_date) AS d FROM ctxns
        WHERE category_id = '1-URGENT' AND amount >= 300000 GROUP BY account_id
        UNION ALL
        SELECT w.account_id, min(t.transaction_date) FROM cwalk w JOIN ctxns t ON t.account_id = w.account_id
        WHERE t.category_id = '1-URGENT' AND t.amount >= 300000 AND t.transaction_date > w.d + 7 GROUP BY w.account_id""",
    ),
    "periods": (
        "walk",
        f"""SELECT account_id, d AS period_start, COALESCE(lead(d) OVER (PARTITION BY account_id ORDER BY d) - 1, {ACTIVE}) AS period_end
        FROM walk""",
    ),
    "cperiods": (
        "cwalk",
        f"""SELECT account_id, d AS period_start, COALESCE(lead(d) OVER (PARTITION BY account_id ORDER BY d) - 1, {ACTIVE}) AS period_end
        FROM cwalk""",
    ),
    "pps": ("txns periods cats", "PPS"),
    "cpps": ("ctxns cperiods cats", "CPPS"),
    "mspend": (
        "txns",
        """SELECT account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, category_id,
        SUM(amount) AS amount, COUNT(*) AS n FROM txns GROUP BY ALL""",
    ),
    "tspend": (
        "mspend cats",
        """SELECT account_id, month, type_id, SUM(amount) AS amount FROM mspend JOIN cats ON cats.id = category_id GROUP BY ALL""",
    ),
    "lines": (
        "",
        """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_suppkey AS account_id,
        CAST(l_shipdate AS DATE) AS transaction_date, p_brand AS category_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
        p_name AS description FROM lineitem JOIN part ON p_partkey = l_partkey""",
    ),
    "statement": (
        "",
        """SELECT l_linenumber AS account_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate,
        CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_shipdate AS DATE) END AS transaction_date,
        CASE WHEN l_orderkey % 89 = 0 THEN NULL WHEN l_orderkey % 83 = 0 THEN 0
             ELSE CAST(l_quantity * 100 AS DECIMAL(12,2)) END AS amount,
        p_name AS raw_description, l_returnflag = 'R' AND l_orderkey % 83 <> 0 AS is_credit,
        CASE WHEN l_orderkey % 79 <> 0 AND l_orderkey % 5 <> 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS balance,
        l_orderkey % 79 = 0 AS bad_balance
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    ),
    "sledger": (
        "",
        """SELECT l_linenumber AS account_id, CAST(l_shipdate AS DATE) AS transaction_date,
        CAST(l_quantity * 100 AS DECIMAL(12,2)) AS amount, p_name AS raw_description
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate < TIMESTAMP '1997-01-01'""",
    ),
    "rules": (
        "",
        f"SELECT * FROM (VALUES {_values(RULE_ROWS)}) v(keyword, category_id, priority)",
    ),
    "ruled": (
        "rules",
        """SELECT p_name, (SELECT r.category_id FROM rules r WHERE contains(upper(p_name), upper(r.keyword))
        ORDER BY r.priority DESC, r.keyword LIMIT 1) AS category_id FROM (SELECT DISTINCT p_name FROM part)""",
    ),
    "readable": (
        "statement",
        "SELECT * FROM statement WHERE transaction_date IS NOT NULL AND amount IS NOT NULL AND NOT bad_balance",
    ),
    "outcome": (
        "readable ruled sledger",
        """SELECT s.* EXCLUDE (bad_balance), r.category_id,
        row_number() OVER (PARTITION BY s.account_id, s.transaction_date, s.amount, s.raw_description
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS copy_no,
        EXISTS (SELECT 1 FROM sledger g WHERE g.account_id = s.account_id AND g.transaction_date = s.transaction_date
            AND g.amount = s.amount AND g.raw_description = s.raw_description) AS known
        FROM readable s LEFT JOIN ruled r ON r.p_name = s.raw_description WHERE s.amount > 0""",
    ),
    "sheets": (
        "",
        """SELECT o_custkey AS account_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS col,
        SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS amount FROM orders GROUP BY ALL""",
    ),
    "mapping": (
        "",
        f"SELECT * FROM (VALUES {_values(SHEET_MAPPING)}) v(col, category, day_offset, description)",
    ),
    "requests": (
        "txns cats",
        """SELECT t.id AS request_id, t.account_id, 'Order ' || t.id AS item, transaction_date AS purchase_date,
        CASE WHEN t.id % 70 = 1 THEN 0 ELSE amount END AS price,
        CASE WHEN t.id % 50 = 0 THEN 'Yacht' ELSE upper(c.name) END AS asked,
        CASE WHEN t.id % 3 = 0 THEN 0.75 WHEN t.id % 90 = 1 THEN 1.20 ELSE 0.90 END AS threshold
        FROM txns t JOIN cats c ON c.id = t.category_id""",
    ),
    "chosen": (
        "requests cats types budgets",
        """SELECT r.*, c.id AS category_id, c.name AS category, c.type_id,
        CAST(date_trunc('month', purchase_date) AS DATE) AS month,
        (SELECT b.budget_amount FROM budgets b WHERE b.account_id = r.account_id AND b.category_id = c.id
          AND b.start_date <= purchase_date AND b.end_date > purchase_date ORDER BY b.start_date DESC, b.id DESC LIMIT 1) AS own_budget,
        (SELECT b.budget_amount FROM budgets b WHERE b.account_id = r.account_id AND b.type_id = c.type_id AND b.category_id IS NULL
          AND b.start_date <= purchase_date AND b.end_date > purchase_date ORDER BY b.start_date DESC, b.id DESC LIMIT 1) AS envelope
        FROM requests r JOIN cats c ON lower(c.name) = lower(r.asked)
        WHERE price > 0 AND threshold <= 1""",
    ),
    "cases": (
        "chosen mspend tspend",
        """SELECT c.*, COALESCE(own_budget, envelope) AS budget,
        CASE WHEN own_budget IS NOT NULL THEN 'category' WHEN envelope IS NOT NULL THEN c.type_id || '_envelope'
             ELSE 'unbudgeted_category' END AS scope,
        COALESCE(CASE WHEN own_budget IS NOT NULL THEN s.amount ELSE t.amount END, 0) AS spent
        FROM chosen c
        LEFT JOIN mspend s ON s.account_id = c.account_id AND s.month = c.month AND s.category_id = c.category_id
        LEFT JOIN tspend t ON t.account_id = c.account_id AND t.month = c.month AND t.type_id = c.type_id""",
    ),
    "scd": (
        "changes cbudgets",
        f"""SELECT c.*, b.budget_amount AS old_amount, b.start_date AS since,
        count(*) FILTER (WHERE c.budget_amount >= 0 AND c.start_date < {ACTIVE})
            OVER (PARTITION BY c.account_id, c.type_id, c.category_id) AS n,
        c.budget_amount >= 0 AS good_amount, c.start_date < {ACTIVE} AS good_start
        FROM changes c LEFT JOIN cbudgets b ON b.account_id = c.account_id AND b.type_id = c.type_id
        AND b.category_id IS NOT DISTINCT FROM c.category_id AND b.end_date = {ACTIVE}""",
    ),
}


def _period_summary(txns: str, periods: str) -> str:
    return f"""SELECT *, CAST(SUM(total_amount) OVER (PARTITION BY account_id, category_type ORDER BY period_start_date) AS DECIMAL(18,2)) AS running_total
    FROM (
      SELECT account_id, period_label, period_start_date, period_end_date, period_basis, category_id,
        cats.name AS category_name, cats.kind AS category_type, cats.type_id AS type_name,
        COUNT(*) AS transaction_count, {money('SUM(amount)')} AS total_amount,
        CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_amount
      FROM (
        SELECT t.account_id, t.category_id, t.amount,
          CASE WHEN p.period_start IS NULL THEN strftime(t.transaction_date, '%Y-%m') ELSE CAST(p.period_start AS VARCHAR) END AS period_label,
          CASE WHEN p.period_start IS NULL THEN CAST(date_trunc('month', t.transaction_date) AS DATE) ELSE p.period_start END AS period_start_date,
          CASE WHEN p.period_start IS NULL THEN last_day(t.transaction_date) ELSE p.period_end END AS period_end_date,
          CASE WHEN p.period_start IS NULL THEN 'calendar_fallback' ELSE 'payday' END AS period_basis
        FROM {txns} t LEFT JOIN {periods} p ON p.account_id = t.account_id
          AND t.transaction_date BETWEEN p.period_start AND p.period_end
      ) JOIN cats ON cats.id = category_id GROUP BY ALL)"""


RELATIONS["pps"] = ("txns periods cats", _period_summary("txns", "periods"))
RELATIONS["cpps"] = ("ctxns cperiods cats", _period_summary("ctxns", "cperiods"))


def sql(reads: str, body: str) -> str:
    """A statement with the relations it reads, and those they read, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in RELATIONS[name][0].split():
            add(other)
        order.append(name)

    for name in reads.split():
        add(name)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({RELATIONS[n][1]})" for n in order) + "\n" + body


def _calendar(d: str) -> str:
    f = f"CAST({d} - 13 AS DATE)"
    return f"""CAST(year({d}) AS INTEGER) AS year, CAST(month({d}) AS INTEGER) AS month, CAST(day({d}) AS INTEGER) AS day,
    CAST(dayofweek({d}) AS INTEGER) AS day_of_week, strftime({d}, '%A') AS day_name, strftime({d}, '%B') AS month_name,
    dayofweek({d}) IN (0, 6) AS is_weekend, CAST(quarter({d}) AS INTEGER) AS quarter,
    CAST(year({f}) AS INTEGER) AS fiscal_year, CAST(month({f}) AS INTEGER) AS fiscal_month,
    strftime({f}, '%Y-%m') AS fiscal_month_label, CAST(date_trunc('month', {d}) AS DATE) AS first_of_calendar_month,
    CAST(CAST(date_trunc('month', {f}) AS DATE) + 13 AS DATE) AS first_of_fiscal_month"""


SAVINGS = f"""SELECT account_id, period_label, period_start_date, period_end_date, period_basis, total_income, total_expenses, total_savings,
  {money('total_income - total_expenses')} AS net_income, {money('total_income - total_expenses - total_savings')} AS remaining_after_savings,
  {pct('total_income - total_expenses', 'total_income')} AS net_savings_rate_pct, {pct('total_savings', 'total_income')} AS explicit_savings_rate_pct,
  CAST(SUM(total_expenses) OVER w AS DOUBLE) / COUNT(*) OVER w AS avg_expenses_3_periods,
  CAST(SUM(total_income) OVER w AS DOUBLE) / COUNT(*) OVER w AS avg_income_3_periods
  FROM (SELECT account_id, period_label, period_start_date, period_end_date, period_basis,
    {total_if("category_type = 'income'", 'total_amount')} AS total_income,
    {total_if("category_type = 'expense'", 'total_amount')} AS total_expenses,
    {total_if("category_type = 'saving'", 'total_amount')} AS total_savings FROM pps GROUP BY ALL)
  WINDOW w AS (PARTITION BY account_id ORDER BY period_start_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""

PAGE_COLUMNS = "t.id, t.account_id, t.transaction_date, t.amount, c.name AS category_name, c.type_id AS type_name"

REJECT_TEXT = """concat_ws('; ',
  CASE WHEN l_orderkey % 89 = 0 THEN 'bad amount' END, CASE WHEN bad_balance THEN 'bad balance' END,
  CASE WHEN l_orderkey % 97 = 0 THEN 'bad date' END)"""

REQUEST_REJECT = """concat_ws('; ', CASE WHEN price <= 0 THEN 'price must be positive' END,
  CASE WHEN threshold > 1 THEN 'warning_threshold out of range' END)"""

STATUS_BODY = f"""SELECT account_id, month, budget_name, budget_scope, type, {money('budget_amount')} AS budget, {money('actual')} AS actual,
  {pct('actual', 'budget_amount')} AS utilisation_pct,
  CASE WHEN actual > budget_amount THEN 'over_budget' WHEN actual > budget_amount * 0.9 THEN 'near_budget' ELSE 'on_track' END AS status
  FROM (SELECT b.account_id, x.month, COALESCE(c.name, b.type_id || ' envelope') AS budget_name,
    CASE WHEN b.category_id IS NULL THEN 'type_envelope' ELSE 'category' END AS budget_scope, b.type_id AS type, b.budget_amount,
    COALESCE(CASE WHEN b.category_id IS NULL THEN t.amount ELSE s.amount END, 0) AS actual
    FROM budgets b
    JOIN (MONTHS) x ON x.account_id = b.account_id
    LEFT JOIN cats c ON c.id = b.category_id
    LEFT JOIN mspend s ON s.account_id = b.account_id AND s.month = x.month AND s.category_id = b.category_id
    LEFT JOIN tspend t ON t.account_id = b.account_id AND t.month = x.month AND t.type_id = b.type_id
    WHERE b.start_date <= x.day AND b.end_date > x.day)"""

IMPORT_ROW = """account_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, transaction_date, amount, raw_description,
  is_credit, balance, category_id"""

ORACLE: dict[str, str] = {
    "fiscal_calendar": sql("txns", f"SELECT id, transaction_date, {_calendar('transaction_date')} FROM txns"),
    "activity_per_day": sql(
        "txns",
        f"""SELECT s.account_id, s.transaction_date, COUNT(t.id) AS transaction_count, {money('COALESCE(SUM(t.amount), 0)')} AS amount
        FROM (SELECT account_id, CAST(unnest(generate_series(min(transaction_date), max(transaction_date), INTERVAL 1 DAY)) AS DATE) AS transaction_date
              FROM txns GROUP BY account_id) s
        LEFT JOIN txns t ON t.account_id = s.account_id AND t.transaction_date = s.transaction_date GROUP BY ALL""",
    ),
    "parsed_statement": sql("readable", "SELECT * EXCLUDE (bad_balance) REPLACE (CAST(amount AS DECIMAL(12,2)) AS amount) FROM readable"),
    "parsed_statement_rejects": sql(
        "statement",
        f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, {REJECT_TEXT} AS reasons FROM statement
        WHERE transaction_date IS NULL OR amount IS NULL OR bad_balance""",
    ),
    "read_statements": sql(
        "readable",
        """SELECT account_id, transaction_date, CAST(amount AS DECIMAL(12,2)) AS amount,
        '"' || raw_description || '", Sydney' AS raw_description, is_credit, balance FROM readable""",
    ),
    "unpivoted_sheets_per_account": sql(
        "sheets mapping acats",
        """SELECT account_id, month, CAST(month + day_offset AS DATE) AS transaction_date, acats.id AS category_id,
        CAST(amount AS DECIMAL(12,2)) AS amount, description, 'card' AS payment_method
        FROM sheets JOIN mapping USING (col) JOIN acats USING (account_id) WHERE acats.name = category AND amount <> 0""",
    ),
    "unpivoted_sheets": sql(
        "sheets mapping cats",
        """SELECT account_id, month, CAST(month + day_offset AS DATE) AS transaction_date, cats.id AS category_id,
        CAST(amount AS DECIMAL(12,2)) AS amount, description, 'card' AS payment_method
        FROM sheets JOIN mapping USING (col) JOIN cats ON cats.name = category WHERE amount <> 0""",
    ),
    "sheet_warnings": sql(
        "sheets mapping cats",
        """SELECT account_id, month, col AS "column", category, 'Category ''' || category || ''' not found, skipping ' || col AS message
        FROM sheets JOIN mapping USING (col) WHERE category NOT IN (SELECT name FROM cats) AND amount <> 0""",
    ),
    "sheet_balances": sql(
        "sheets mapping cats",
        f"""SELECT account_id, month, {total_if("category = 'Salary'")} AS income, {total_if("category <> 'Salary'")} AS expenses,
        COUNT(*) AS transaction_count, {money("COALESCE(SUM(CASE WHEN category = 'Salary' THEN amount ELSE -amount END), 0)")} AS net
        FROM sheets JOIN mapping USING (col) JOIN cats ON cats.name = category WHERE amount <> 0 GROUP BY account_id, month""",
    ),
    "breakdown_transactions": """SELECT l_orderkey AS label, CAST(l_shipdate AS DATE) AS transaction_date,
        CASE l_returnflag WHEN 'R' THEN '2-HIGH' ELSE '3-MEDIUM' END AS category_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
        l_linestatus AS description, 'card' AS payment_method
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice >= 50000 AND l_returnflag IN ('R', 'A')""",
    "reconciled_totals": f"""SELECT label, stated_total, parts_total, {money('stated_total - parts_total')} AS difference,
        abs(stated_total - parts_total) <= 20000 AS matches
        FROM (SELECT o_orderkey AS label, {money('any_value(o_totalprice)')} AS stated_total,
          {money('COALESCE(SUM(CAST(l_extendedprice AS DECIMAL(12,2))), 0)')} AS parts_total
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice >= 50000 GROUP BY o_orderkey)""",
    "stg_categories": sql(
        "acats types",
        """SELECT account_id, acats.id AS category_id, acats.name AS category_name, type_id, types.name AS type_name,
        types.sort_order AS type_sort_order, kind AS category_type FROM acats JOIN types ON types.id = type_id""",
    ),
    "enriched_transactions": sql(
        "ctxns cats",
        """SELECT t.account_id, t.category_id, t.id, t.amount, c.name AS category_name, c.type_id, c.type_id AS type_name
        FROM ctxns t LEFT JOIN cats c ON c.id = t.category_id AND EXISTS (SELECT 1 FROM ctxns b WHERE b.account_id = t.account_id
          AND b.category_id = t.category_id AND b.amount >= 250000)""",
    ),
    "enriched_transactions_inner": sql(
        "ctxns cats",
        """SELECT t.account_id, t.category_id, t.id, t.amount, c.name AS category_name, c.type_id, c.type_id AS type_name
        FROM ctxns t JOIN cats c ON c.id = t.category_id
        WHERE (t.account_id, t.category_id) IN (SELECT (account_id, category_id) FROM ctxns WHERE amount >= 250000)""",
    ),
    "pay_periods": sql("periods", "SELECT * FROM periods"),
    "stg_transactions": sql(
        "txns periods",
        """SELECT t.account_id, t.id, t.transaction_date, t.category_id, t.savings_goal_id, t.amount,
        COALESCE(t.description, 'No description') AS description, t.payment_method, t.is_recurring, t.source,
        CAST(year(t.transaction_date) AS INTEGER) AS calendar_year, CAST(month(t.transaction_date) AS INTEGER) AS calendar_month,
        CAST(day(t.transaction_date) AS INTEGER) AS calendar_day, CAST(dayofweek(t.transaction_date) AS INTEGER) AS day_of_week,
        strftime(t.transaction_date, '%A') AS day_name, strftime(t.transaction_date, '%B') AS month_name,
        dayofweek(t.transaction_date) IN (0, 6) AS is_weekend, CAST(quarter(t.transaction_date) AS INTEGER) AS quarter,
        p.period_start AS pay_period_start, p.period_end AS pay_period_end, strftime(t.transaction_date, '%Y-%m') AS year_month
        FROM txns t LEFT JOIN periods p ON p.account_id = t.account_id AND t.transaction_date >= p.period_start AND t.transaction_date <= p.period_end""",
    ),
    "fct_pay_period_summary": sql("pps", "SELECT * FROM pps"),
    "fct_pay_period_summary_by_customer": sql("cpps", "SELECT * FROM cpps"),
    "fct_pay_period_summary_calendar": sql(
        "txns cats",
        f"""SELECT *, CAST(SUM(total_amount) OVER (PARTITION BY account_id, category_type ORDER BY period_start_date) AS DECIMAL(18,2)) AS running_total
        FROM (SELECT account_id, strftime(transaction_date, '%Y-%m') AS period_label, CAST(date_trunc('month', transaction_date) AS DATE) AS period_start_date,
          last_day(transaction_date) AS period_end_date, 'calendar' AS period_basis, category_id, cats.name AS category_name,
          cats.kind AS category_type, cats.type_id AS type_name, COUNT(*) AS transaction_count, {money('SUM(amount)')} AS total_amount,
          CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_amount FROM txns JOIN cats ON cats.id = category_id GROUP BY ALL)""",
    ),
    "fct_monthly_summary": sql("pps", "SELECT * FROM pps"),
    "fct_savings_rate": sql("pps", SAVINGS),
    "fct_savings_rate_of_year": sql("pps", f"SELECT * FROM ({SAVINGS}) WHERE year(period_start_date) = 1999"),
    "fct_budget_vs_actual": sql(
        "pps budgets cats",
        f"""SELECT account_id, fiscal_month, period_start_date, period_end_date, period_basis, category_name, category_type,
          {money('budget_amount')} AS budget_amount, {money('actual')} AS actual_amount, {money('budget_amount - actual')} AS variance,
          {pct('actual', 'budget_amount')} AS utilisation_pct, CAST(n AS BIGINT) AS transaction_count, start_date AS budget_since,
          CASE WHEN actual > budget_amount THEN 'over_budget' WHEN actual >= budget_amount * 0.9 THEN 'near_budget' ELSE 'within_budget' END AS budget_status
        FROM (SELECT p.account_id, p.period_label AS fiscal_month, p.period_start_date, p.period_end_date, p.period_basis,
          cats.name AS category_name, cats.kind AS category_type, b.budget_amount, b.start_date,
          COALESCE(a.total_amount, 0) AS actual, COALESCE(a.transaction_count, 0) AS n
          FROM budgets b JOIN cats ON cats.id = b.category_id
          JOIN (SELECT DISTINCT account_id, period_label, period_start_date, period_end_date, period_basis FROM pps) p
            ON p.account_id = b.account_id AND p.period_end_date >= b.start_date AND p.period_start_date < b.end_date
          LEFT JOIN pps a ON a.account_id = b.account_id AND a.category_id = b.category_id
            AND a.period_start_date = p.period_start_date AND a.period_end_date = p.period_end_date
          WHERE b.end_date = {ACTIVE})""",
    ),
    "fct_expense_group_summary": sql(
        "pps budgets",
        f"""SELECT account_id, fiscal_month, period_start_date, period_end_date, period_basis, expense_group,
          CAST(n AS BIGINT) AS transaction_count, {money('spent')} AS total_actual, {money('planned')} AS total_budget,
          {money('spent - planned')} AS over_under, {pct('spent', 'planned')} AS utilisation_pct,
          CASE WHEN spent > planned THEN 'over' WHEN spent >= planned * 0.9 THEN 'near_limit' ELSE 'on_track' END AS budget_status
        FROM (SELECT account_id, period_label AS fiscal_month, period_start_date, period_end_date, period_basis, type_name AS expense_group,
            SUM(transaction_count) AS n, SUM(total_amount) AS spent FROM pps WHERE type_name IN ('fixed', 'variable') GROUP BY ALL)
        LEFT JOIN (SELECT account_id, type_id AS expense_group, SUM(budget_amount) AS planned FROM budgets WHERE end_date = {ACTIVE} GROUP BY ALL)
          USING (account_id, expense_group)""",
    ),
    "written_marts": sql(
        "pps budgets",
        f"""SELECT 'fct_pay_period_summary' AS "table", COUNT(*) AS row_count FROM pps
        UNION ALL SELECT 'fct_monthly_summary', COUNT(*) FROM pps
        UNION ALL SELECT 'fct_savings_rate', COUNT(DISTINCT (account_id, period_label)) FROM pps
        UNION ALL SELECT 'fct_expense_group_summary', COUNT(DISTINCT (account_id, period_label, type_name)) FROM pps WHERE type_name IN ('fixed', 'variable')
        UNION ALL SELECT 'fct_budget_vs_actual', COUNT(*) FROM (SELECT DISTINCT account_id, period_label, period_start_date, period_end_date FROM pps) p
          JOIN budgets b ON b.account_id = p.account_id AND b.category_id IS NOT NULL AND b.end_date = {ACTIVE}
          AND p.period_end_date >= b.start_date AND p.period_start_date < b.end_date""",
    ),
    "v_monthly_summary": sql(
        "txns cats",
        f"""SELECT account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, type_id AS type_name, name AS category_name,
        COUNT(*) AS transaction_count, {money('SUM(amount)')} AS total_amount, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_amount
        FROM txns JOIN cats ON cats.id = category_id GROUP BY ALL""",
    ),
    "v_monthly_summary_of_month": sql(
        "txns cats",
        f"""SELECT account_id, DATE '1997-03-01' AS month, type_id AS type_name, name AS category_name,
        COUNT(*) AS transaction_count, {money('SUM(amount)')} AS total_amount, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_amount
        FROM txns JOIN cats ON cats.id = category_id WHERE strftime(transaction_date, '%Y-%m') = '1997-03' GROUP BY ALL""",
    ),
    "v_budget_vs_actual": sql(
        "txns budgets cats",
        f"""SELECT account_id, month, category_name, {money('budget_amount')} AS budget_amount, {money('actual')} AS actual_amount,
        {money('budget_amount - actual')} AS remaining, {pct('actual', 'budget_amount')} AS utilisation_pct
        FROM (SELECT b.account_id, CAST(date_trunc('month', t.transaction_date) AS DATE) AS month, cats.name AS category_name, b.budget_amount,
          COALESCE(SUM(t.amount), 0) AS actual FROM budgets b JOIN cats ON cats.id = b.category_id
          LEFT JOIN txns t ON t.account_id = b.account_id AND t.category_id = b.category_id
            AND t.transaction_date >= b.start_date AND t.transaction_date < b.end_date
          WHERE b.end_date = {ACTIVE} GROUP BY ALL)""",
    ),
    "monthly_spending": sql(
        "mspend cats",
        f"""SELECT account_id, month, name AS category, {money('amount')} AS total, n AS transaction_count
        FROM mspend JOIN cats ON cats.id = category_id""",
    ),
    "monthly_spending_of_category": sql(
        "ctxns",
        f"""SELECT account_id, DATE '1997-03-01' AS month, 'Groceries' AS category, {money('SUM(amount)')} AS total, COUNT(*) AS transaction_count
        FROM ctxns WHERE category_id = '3-MEDIUM' AND strftime(transaction_date, '%Y-%m') = '1997-03' GROUP BY account_id""",
    ),
    "monthly_totals": sql(
        "ctxns cats",
        f"""SELECT account_id, month, total_income, total_expenses, total_savings, {money('total_income - total_expenses')} AS net_after_expenses,
        {money('total_income - total_expenses - total_savings')} AS remaining_after_savings,
        {pct('total_income - total_expenses', 'total_income')} AS savings_rate_pct
        FROM (SELECT account_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, {total_if("kind = 'income'")} AS total_income,
          {total_if("kind = 'expense'")} AS total_expenses, {total_if("kind = 'saving'")} AS total_savings
          FROM ctxns JOIN cats ON cats.id = category_id GROUP BY ALL)""",
    ),
    "budget_status": sql(
        "budgets cats mspend tspend",
        STATUS_BODY.replace(
            "MONTHS",
            """SELECT DISTINCT account_id, month, CASE WHEN last_day(month) < DATE '1998-07-15' THEN last_day(month)
            WHEN month > DATE '1998-07-15' THEN month ELSE DATE '1998-07-15' END AS day FROM mspend""",
        ),
    ),
    "budget_status_of_month": sql(
        "budgets cats mspend tspend",
        STATUS_BODY.replace(
            "MONTHS", "SELECT n_nationkey AS account_id, DATE '1998-07-01' AS month, DATE '1998-07-15' AS day FROM nation"
        ),
    ),
    "search_transactions": sql(
        "lines",
        """SELECT account_id, id, transaction_date AS date, amount, 'Parts of ' || category_id AS category, description
        FROM lines WHERE description ILIKE '%d RiNg%' ORDER BY transaction_date DESC, id LIMIT 10""",
    ),
    "search_transactions_per_account": sql(
        "lines",
        """SELECT account_id, id, transaction_date AS date, amount, 'Parts of ' || category_id AS category, description
        FROM lines WHERE description ILIKE '%b%t%'
        QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY transaction_date DESC, id) <= 5""",
    ),
    "list_transactions": sql(
        "txns cats",
        f"""SELECT {PAGE_COLUMNS} FROM txns t JOIN cats c ON c.id = t.category_id ORDER BY t.transaction_date DESC, t.id LIMIT 100 OFFSET 100""",
    ),
    "list_transactions_of_month": sql(
        "txns cats",
        f"""SELECT {PAGE_COLUMNS} FROM txns t JOIN cats c ON c.id = t.category_id
        WHERE t.category_id = '2-HIGH' AND t.transaction_date BETWEEN DATE '1998-12-01' AND DATE '1998-12-31'
        ORDER BY t.transaction_date DESC, t.id LIMIT 1000""",
    ),
    "list_transactions_per_account": sql(
        "ctxns cats",
        f"""SELECT {PAGE_COLUMNS} FROM ctxns t JOIN cats c ON c.id = t.category_id
        QUALIFY row_number() OVER (PARTITION BY t.account_id ORDER BY t.transaction_date DESC, t.id) BETWEEN 2 AND 4""",
    ),
    "list_transactions_after": sql(
        "ctxns cats",
        f"""SELECT {PAGE_COLUMNS} FROM ctxns t JOIN cats c ON c.id = t.category_id
        QUALIFY row_number() OVER (PARTITION BY t.account_id ORDER BY t.transaction_date DESC, t.id) BETWEEN 3 AND 4""",
    ),
    "get_transactions": sql(
        "txns cats",
        """SELECT t.id, t.account_id, t.amount, c.name AS category_name, c.type_id AS type_name FROM txns t JOIN cats c ON c.id = t.category_id
        WHERE t.id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)""",
    ),
    "goal_linked_transactions": sql(
        "txns", "SELECT id, account_id, savings_goal_id, amount FROM txns WHERE category_id = '5-LOW'"
    ),
    "list_pay_dates": sql(
        "cwalk",
        "SELECT account_id, d AS pay_date, 'auto' AS source, 'Detected from Salary transaction' AS note FROM cwalk",
    ),
    "list_categories": sql(
        "acats types",
        """SELECT account_id, acats.id AS category_id, acats.name AS category_name, type_id, types.name AS type_name,
        types.sort_order AS type_sort_order, kind AS category_type FROM acats JOIN types ON types.id = type_id WHERE type_id = 'variable'""",
    ),
    "list_rules": """SELECT p_brand AS category_id, p_name || ' ' || p_partkey AS keyword, p_size AS priority,
        'Parts of ' || p_brand AS category_name FROM part""",
    "list_budgets": sql(
        "cbudgets types cats",
        f"""SELECT b.account_id, b.id, b.type_id, t.name AS type_name, t.sort_order AS type_sort_order, b.category_id,
        COALESCE(c.name, '-- ALL --') AS category_name, b.start_date, b.end_date, b.budget_amount, 'active' AS status
        FROM cbudgets b JOIN types t ON t.id = b.type_id LEFT JOIN cats c ON c.id = b.category_id WHERE b.end_date = {ACTIVE}""",
    ),
    "list_budgets_with_history": sql(
        "cbudgets types cats",
        f"""SELECT b.account_id, b.id, b.type_id, t.name AS type_name, t.sort_order AS type_sort_order, b.category_id,
        COALESCE(c.name, '-- ALL --') AS category_name, b.start_date, b.end_date, b.budget_amount,
        CASE WHEN b.end_date = {ACTIVE} THEN 'active' ELSE 'historical' END AS status
        FROM cbudgets b JOIN types t ON t.id = b.type_id LEFT JOIN cats c ON c.id = b.category_id WHERE b.type_id = 'fixed'""",
    ),
    "categories_by_type": sql(
        "acats types",
        """SELECT account_id, types.name AS type_name, types.sort_order AS type_sort_order,
        string_agg(acats.name, ', ' ORDER BY acats.name) AS categories, COUNT(*) AS category_count
        FROM acats JOIN types ON types.id = type_id GROUP BY ALL""",
    ),
    "goal_progress": sql(
        "goals",
        f"""SELECT id, account_id, name, {money('current_amount')} AS current_amount, {money('target_amount')} AS target_amount,
        {pct0('current_amount', 'target_amount')} AS progress_pct FROM goals WHERE status = 'active'""",
    ),
    "list_goals": sql("goals", "SELECT * FROM goals WHERE status = 'paused'"),
    "count_checks": """SELECT 'row_count' AS "check", 'orders' AS "table", '= 1000' AS "column", abs(COUNT(*) - 1000) AS violations FROM orders
        UNION ALL SELECT 'distinct_count', 'orders', 'o_orderpriority', abs(COUNT(DISTINCT o_orderpriority) - 5) FROM orders
        UNION ALL SELECT 'distinct_count', 'orders', 'o_custkey', COUNT(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 'row_parity', 'orders and customers', '*', abs((SELECT COUNT(*) FROM orders) - (SELECT COUNT(*) FROM customer))""",
    "looked_up_parts": sql(
        "lines",
        """SELECT id, (SELECT min(p_partkey) FROM part WHERE p_name = description AND p_name NOT LIKE 'red%') AS part_id FROM lines""",
    ),
    "plan_summary": sql(
        "cbudgets",
        f"""SELECT account_id, fixed_total, envelope_total, {money('fixed_total + envelope_total')} AS grand_total,
        {money('bal * 4 - fixed_total - envelope_total')} AS expected_savings
        FROM (SELECT account_id, {total_if('category_id IS NOT NULL', 'budget_amount')} AS fixed_total,
          {total_if('category_id IS NULL', 'budget_amount')} AS envelope_total FROM cbudgets WHERE end_date = {ACTIVE} GROUP BY account_id)
        JOIN (SELECT c_custkey AS account_id, abs(CAST(c_acctbal AS DECIMAL(12,2))) AS bal FROM customer) USING (account_id)""",
    ),
    "nested_monthly_spending": sql(
        "mspend cats",
        f"""SELECT account_id, month, '{{' || string_agg('"' || name || '":{{"total":' || CAST({money('amount')} AS VARCHAR)
        || ',"transaction_count":' || n || '}}', ',' ORDER BY name) || '}}' AS json
        FROM mspend JOIN cats ON cats.id = category_id GROUP BY account_id, month""",
    ),
    "assess_purchases": sql(
        "cases",
        f"""SELECT request_id, account_id, item, category, type_id AS expense_type, 'AUD' AS currency, month AS period_start,
          CAST(month + INTERVAL 1 MONTH AS DATE) AS period_end_exclusive, scope AS budget_scope, {money('price')} AS purchase_price,
          {money('spent')} AS spent_so_far, decision, CASE WHEN budget IS NOT NULL THEN decision <> 'over_budget' END AS can_buy_within_budget,
          {money('budget')} AS budget_amount, {money('budget - spent')} AS remaining_before_purchase, {money('spent + price')} AS projected_spend,
          {money('budget - spent - price')} AS remaining_after_purchase, used AS projected_utilisation_pct,
          CASE decision
            WHEN 'no_budget' THEN 'No monthly budget is configured for ' || category || ' or its ' || type_id || ' expense envelope.'
            WHEN 'over_budget' THEN 'The purchase would exceed the ' || scope || ' budget by $' || CAST({money('spent + price - budget')} AS VARCHAR) || '.'
            WHEN 'tight' THEN 'The purchase fits, but would use ' || CAST(CAST(used AS DECIMAL(18,1)) AS VARCHAR) || '% of the ' || scope || ' budget.'
            ELSE 'The purchase fits the ' || scope || ' budget with $' || CAST({money('budget - spent - price')} AS VARCHAR) || ' remaining.' END AS reason
        FROM (SELECT *, {pct('spent + price', 'budget', 'NULL')} AS used,
          CASE WHEN budget IS NULL THEN 'no_budget' WHEN spent + price > budget THEN 'over_budget'
               WHEN spent + price >= budget * threshold THEN 'tight' ELSE 'within_budget' END AS decision FROM cases)""",
    ),
    "assess_purchases_rejects": sql(
        "requests",
        f"""SELECT request_id, asked AS category_name, CASE WHEN price > 0 AND threshold <= 1 THEN 'unknown category' ELSE {REQUEST_REJECT} END AS reasons
        FROM requests WHERE NOT (price > 0 AND threshold <= 1) OR asked = 'Yacht'""",
    ),
    "resolved_budgets": sql(
        "txns cats budgets",
        """SELECT d.account_id, d.category_id, d.type_id, d.purchase_date, b.id AS budget_id, b.budget_amount,
        CASE WHEN b.id IS NULL THEN NULL WHEN b.category_id IS NULL THEN 'envelope' ELSE 'category' END AS scope
        FROM (SELECT DISTINCT account_id, category_id, type_id, transaction_date AS purchase_date FROM txns JOIN cats ON cats.id = category_id) d
        LEFT JOIN budgets b ON b.account_id = d.account_id AND b.start_date <= d.purchase_date AND d.purchase_date < b.end_date
          AND (b.category_id = d.category_id OR (b.category_id IS NULL AND b.type_id = d.type_id))
        QUALIFY row_number() OVER (PARTITION BY d.account_id, d.category_id, d.purchase_date
          ORDER BY b.category_id IS NULL, b.start_date DESC, b.id DESC) = 1""",
    ),
    "budgets_in_force": sql(
        "cbudgets", "SELECT * FROM cbudgets WHERE start_date <= DATE '1998-01-01' AND end_date > DATE '1998-01-01'"
    ),
    "reference_days": sql(
        "txns",
        """SELECT id, CASE WHEN strftime(transaction_date, '%Y-%m') = '1998-07' THEN DATE '1998-07-15'
        WHEN transaction_date < DATE '1998-07-01' THEN last_day(transaction_date)
        ELSE CAST(date_trunc('month', transaction_date) AS DATE) END AS reference_day FROM txns""",
    ),
    "scd2_budgets": sql(
        "scd",
        f"""SELECT b.account_id, b.id, b.type_id, b.category_id, b.start_date,
          CASE WHEN b.end_date = {ACTIVE} AND s.id IS NOT NULL THEN DATE '2001-08-01' ELSE b.end_date END AS end_date, b.budget_amount
        FROM cbudgets b LEFT JOIN (SELECT * FROM scd WHERE n = 1 AND good_amount AND good_start AND old_amount <> budget_amount) s
          ON s.account_id = b.account_id AND s.type_id = b.type_id AND s.category_id IS NOT DISTINCT FROM b.category_id
        UNION ALL
        SELECT account_id, id, type_id, category_id, start_date, {ACTIVE}, budget_amount FROM scd
        WHERE n = 1 AND good_amount AND good_start AND old_amount IS DISTINCT FROM budget_amount""",
    ),
    "scd2_rejects": sql(
        "scd",
        """SELECT account_id, id, type_id, category_id, CASE WHEN NOT good_amount OR NOT good_start THEN
          concat_ws('; ', CASE WHEN NOT good_amount THEN 'budget_amount must not be negative' END, CASE WHEN NOT good_start THEN 'end_date must follow start_date' END)
          WHEN n > 1 THEN 'several changes of one budget' ELSE 'version would end on or before its first day' END AS reasons
        FROM scd WHERE NOT good_amount OR NOT good_start OR n > 1
          OR (since >= DATE '1998-01-01' AND old_amount <> budget_amount)""",
    ),
    "overwritten_budgets": sql(
        "cbudgets",
        f"""SELECT account_id, id, type_id, category_id,
          CASE WHEN type_id = 'variable' AND account_id % 2 = 0 THEN DATE '2001-04-01' ELSE start_date END AS start_date, end_date,
          CASE WHEN type_id = 'variable' AND account_id % 2 = 0 THEN 1700.00 ELSE budget_amount END AS budget_amount FROM cbudgets
        UNION ALL SELECT c_custkey, c_custkey * 10 + 6, 'income', NULL, DATE '2001-04-01', {ACTIVE}, 1700.00 FROM customer WHERE c_custkey % 2 = 1""",
    ),
    "detect_pay_dates": "DETECT",
    "detect_pay_dates_summary": "DETECT",
    "salary_dates_not_near_confirmed": sql(
        "ctxns",
        """SELECT DISTINCT account_id, transaction_date AS pay_date FROM ctxns s WHERE category_id = '1-URGENT' AND NOT EXISTS (
        SELECT 1 FROM ctxns c WHERE c.account_id = s.account_id AND c.category_id = '5-LOW' AND abs(c.transaction_date - s.transaction_date) <= 60)""",
    ),
    "local_days": """SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney' AS DATE) AS local_day FROM events""",
    "import_statement_inserted": sql(
        "outcome",
        """SELECT account_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, transaction_date, category_id,
        CAST(amount AS DECIMAL(12,2)) AS amount, raw_description AS description, CASE WHEN is_credit THEN 'transfer' ELSE 'card' END AS payment_method,
        FALSE AS is_recurring, 'bank_import' AS source, raw_description, '20020101_bank' AS import_batch_id
        FROM outcome WHERE category_id IS NOT NULL AND NOT known AND copy_no = 1""",
    ),
    "import_statement_duplicates": sql(
        "outcome",
        f"SELECT {IMPORT_ROW} FROM outcome WHERE known OR (category_id IS NOT NULL AND copy_no > 1)".replace(
            " amount,", " CAST(amount AS DECIMAL(12,2)) AS amount,"
        ),
    ),
    "import_statement_review": sql(
        "outcome",
        f"SELECT {IMPORT_ROW} FROM outcome WHERE NOT known AND category_id IS NULL".replace(
            " amount,", " CAST(amount AS DECIMAL(12,2)) AS amount,"
        ),
    ),
    "import_statement_rejects": sql(
        "statement",
        f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
        CASE WHEN transaction_date IS NULL OR amount IS NULL OR bad_balance THEN {REJECT_TEXT} ELSE 'amount must be positive' END AS reasons
        FROM statement WHERE transaction_date IS NULL OR amount IS NULL OR bad_balance OR amount <= 0""",
    ),
    "import_statement_summary": sql(
        "outcome",
        """SELECT account_id, COUNT(*) FILTER (WHERE NOT bad AND category_id IS NOT NULL) AS matched,
        COUNT(*) FILTER (WHERE NOT bad AND category_id IS NULL) AS unknown, COUNT(*) FILTER (WHERE ins) AS inserted,
        COUNT(*) FILTER (WHERE NOT bad AND NOT ins) AS skipped, COUNT(*) FILTER (WHERE bad) AS rejected
        FROM (SELECT account_id, category_id, FALSE AS bad, category_id IS NOT NULL AND NOT known AND copy_no = 1 AS ins FROM outcome
          UNION ALL SELECT account_id, NULL, TRUE, FALSE FROM statement
            WHERE transaction_date IS NULL OR amount IS NULL OR bad_balance OR amount <= 0)
        GROUP BY account_id""",
    ),
    "imported_ledger_rows": sql(
        "outcome",
        """SELECT account_id, transaction_date, CAST(amount AS DECIMAL(12,2)) AS amount, raw_description, category_id
        FROM outcome WHERE category_id IS NOT NULL AND NOT known AND copy_no = 1""",
    ),
    "categorised_lines": sql(
        "lines ruled",
        "SELECT id, description, ruled.category_id FROM lines LEFT JOIN ruled ON p_name = description",
    ),
    "categorised_lines_by_join": sql(
        "lines ruled",
        "SELECT id, description, ruled.category_id FROM lines LEFT JOIN ruled ON p_name = description",
    ),
    "categorised_documents": """WITH r AS (SELECT regexp_extract(text, '(\\w+)\\W*$', 1) AS keyword, item_id, length(text) AS priority FROM benchmark)
        SELECT doc_id, category_id FROM documents LEFT JOIN (
        SELECT text, arg_min(item_id, (-priority, keyword, item_id)) AS category_id
        FROM (SELECT DISTINCT text FROM documents) d JOIN r ON contains(upper(d.text), upper(r.keyword)) GROUP BY text) USING (text)""",
    "deduplicated_lines": sql(
        "lines sledger",
        """SELECT id, 1 AS account_id, transaction_date, amount, raw_description FROM (
        SELECT id, CAST(date_trunc('month', transaction_date) AS DATE) AS transaction_date,
          CAST(round(amount, -3) AS DECIMAL(12,2)) AS amount, description AS raw_description FROM lines) b
        WHERE NOT EXISTS (SELECT 1 FROM sledger g WHERE CAST(date_trunc('month', g.transaction_date) AS DATE) = b.transaction_date
          AND CAST(round(g.amount * 10, -3) AS DECIMAL(12,2)) = b.amount AND g.raw_description = b.raw_description)
        QUALIFY row_number() OVER (PARTITION BY transaction_date, amount, raw_description ORDER BY id) = 1""",
    ),
    "streamed_statement_import": sql(
        "outcome",
        """SELECT account_id, transaction_date, category_id, CAST(amount AS DECIMAL(12,2)) AS amount, raw_description AS description,
        CASE WHEN is_credit THEN 'transfer' ELSE 'card' END AS payment_method, 'bank_import' AS source, raw_description
        FROM outcome WHERE category_id IS NOT NULL AND NOT known AND copy_no = 1""",
    ),
    "streamed_statement_reports": sql(
        "outcome statement",
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
        CASE WHEN known OR category_id IS NOT NULL THEN 'duplicates' ELSE 'review' END AS outcome
        FROM outcome WHERE known OR category_id IS NULL OR copy_no > 1
        UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'rejects'
        FROM statement WHERE transaction_date IS NULL OR amount IS NULL OR bad_balance OR amount <= 0""",
    ),
    "insert_missing_days": sql(
        "ctxns",
        """SELECT account_id, transaction_date AS pay_date, CASE WHEN bool_or(category_id = '1-URGENT') THEN 'auto' ELSE 'manual' END AS source
        FROM ctxns WHERE category_id = '1-URGENT' OR amount >= 200000 GROUP BY ALL""",
    ),
    "insert_missing_envelopes": sql(
        "cbudgets",
        f"""SELECT * FROM cbudgets UNION ALL SELECT c_custkey, c_custkey * 10 + 6, 'saving', NULL, DATE '2001-04-01', {ACTIVE}, 1700.00
        FROM customer WHERE c_custkey % 2 = 1""",
    ),
    "upserted_goals": sql(
        "goals ctxns",
        """SELECT g.id, g.account_id, g.name, CAST(COALESCE(b.target, g.target_amount) AS DECIMAL(12,2)) AS target_amount, CASE WHEN b.target IS NULL THEN g.status ELSE 'active' END AS status
        FROM goals g LEFT JOIN (SELECT account_id, max(amount) AS target FROM ctxns WHERE amount >= 400000 GROUP BY 1) b ON b.account_id = g.id""",
    ),
    "patched_goals": sql(
        "goals ctxns",
        """SELECT g.id, g.account_id, g.name, g.target_amount, CAST(COALESCE(b.top, g.current_amount) AS DECIMAL(12,2)) AS current_amount,
        CASE WHEN b.top > 400000 THEN 'completed' ELSE g.status END AS status
        FROM goals g LEFT JOIN (SELECT account_id, max(amount) AS top FROM ctxns WHERE category_id = '5-LOW' AND account_id % 10 <> 0 GROUP BY 1) b ON b.account_id = g.id""",
    ),
    "patch_rejects": sql(
        "ctxns",
        """SELECT -account_id - 1 AS id, max(amount) AS current_amount, CASE WHEN max(amount) > 400000 THEN 'completed' END AS status
        FROM ctxns WHERE category_id = '5-LOW' AND account_id % 10 = 0 GROUP BY account_id""",
    ),
    "deleted_transactions": sql(
        "txns",
        "SELECT id, account_id, amount FROM txns WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    ),
    "appended_transactions": sql(
        "txns lines",
        """SELECT CAST(id AS VARCHAR) AS id, account_id, transaction_date, category_id, amount, payment_method, is_recurring, source FROM txns
        UNION ALL SELECT id, 0, transaction_date, CASE WHEN amount > 20000 THEN '2-HIGH' ELSE '3-MEDIUM' END, amount,
          CASE WHEN category_id = 'Brand#3' THEN 'cash' ELSE 'card' END, FALSE, 'manual' FROM lines WHERE amount >= 2000 AND category_id <> 'Brand#2'""",
    ),
    "append_rejects": sql(
        "lines",
        """SELECT id, concat_ws('; ', CASE WHEN amount < 2000 THEN 'amount must be positive' END,
        CASE WHEN category_id = 'Brand#2' THEN 'unknown payment_method' END) AS reasons FROM lines WHERE amount < 2000 OR category_id = 'Brand#2'""",
    ),
    "backfilled_categories": sql(
        "txns cats",
        """SELECT t.id, t.account_id, c.name AS label, CASE WHEN c.name <> 'Shopping' THEN c.id END AS category_id
        FROM txns t JOIN cats c ON c.id = t.category_id""",
    ),
    "backfill_unmatched": sql("txns", "SELECT id, 'Shopping' AS label FROM txns WHERE category_id = '4-NOT SPECIFIED'"),
    "tagged_lines": sql(
        "lines",
        "SELECT id, description, CASE WHEN description LIKE '%ring' THEN 'fixed' ELSE 'variable' END AS expense_group FROM lines",
    ),
    "unified_budgets": f"""SELECT c_custkey AS account_id, 'fixed' AS type_id, '2-HIGH' AS category_id, DATE '2001-04-01' AS start_date, {ACTIVE} AS end_date,
        CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS budget_amount FROM customer WHERE c_custkey % 20 <> 7
        UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'variable' ELSE 'fixed' END, NULL, DATE '2001-04-01', {ACTIVE},
        CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) * 2 AS DECIMAL(12,2)) FROM customer""",
    "unified_budgets_checks": """SELECT v.* REPLACE (CASE WHEN violations = 0 THEN 0 ELSE n END AS violations)
        FROM (VALUES ('row_parity', 'category budget rows', '*', 1), ('row_parity', 'envelope budget rows', '*', 0),
          ('copied', 'category budget values', 'account_id, category_id, start_date, budget_amount', 1),
          ('copied', 'envelope budget values', 'account_id, type_id, start_date, budget_amount', 0)) v("check", "table", "column", violations),
        (SELECT COUNT(*) AS n FROM customer WHERE c_custkey % 20 = 7)""",
    "loaded_tables": "SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "migration_preflight": """
        WITH kinds(id, kind) AS (VALUES (0, 'fixed'), (1, 'variable'), (2, 'income'), (3, 'saving')),
        needed(name) AS (VALUES ('Groceries'), ('Health'), ('Phone & Internet'), ('Shopping'), ('Subscriptions'), ('Transport'), ('Utilities')),
        g AS (SELECT c_custkey AS a, id, kind AS name FROM customer, kinds WHERE NOT (c_custkey % 10 = 3 AND id = 3)
          UNION ALL SELECT c_custkey, 9, 'other' FROM customer WHERE c_custkey % 10 = 4),
        c AS (SELECT c_custkey AS a, name, CASE WHEN c_custkey % 7 = 0 AND name = 'Health' THEN NULL
            WHEN c_custkey % 17 = 0 AND name = 'Phone & Internet' THEN 9 ELSE 0 END AS gid,
            CASE WHEN c_custkey % 11 = 0 AND name = 'Groceries' THEN 'odd' ELSE 'fixed' END AS type
          FROM customer, needed WHERE NOT (c_custkey % 13 = 0 AND name = 'Utilities')),
        found("check", "table", "column", violations) AS (
          SELECT 'names', 'expense_groups', 'name', COUNT(*) FILTER (n <> 4 OR k <> 4 OR others > 0) FROM (
            SELECT a, COUNT(*) FILTER (name IN (SELECT kind FROM kinds)) AS n, COUNT(DISTINCT CASE WHEN name IN (SELECT kind FROM kinds) THEN name END) AS k,
              COUNT(*) FILTER (name NOT IN (SELECT kind FROM kinds)) AS others FROM g GROUP BY a)
          UNION ALL SELECT 'names', 'categories', 'name', COUNT(*) FILTER (n <> 7) FROM (SELECT a, COUNT(*) AS n FROM c GROUP BY a)
          UNION ALL SELECT 'not_null', 'categories', 'expense_group_id', COUNT(*) FROM c WHERE gid IS NULL
          UNION ALL SELECT 'relationship', 'categories', 'account_id, expense_group_id', COUNT(*) FROM c
            WHERE gid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g WHERE g.a = c.a AND g.id = c.gid)
          UNION ALL SELECT 'same', 'categories', 'type = group_type', COUNT(*) FROM c JOIN g ON g.a = c.a AND g.id = c.gid WHERE c.type <> g.name
          UNION ALL SELECT 'unique', 'monthly_budgets', 'account_id, category_id', COUNT(*) FROM (
            SELECT 1 FROM orders GROUP BY o_custkey, o_orderpriority HAVING COUNT(*) > 1)
          UNION ALL SELECT 'unique', 'monthly_group_budgets', 'account_id, expense_group_id', COUNT(*) FROM (
            SELECT 1 FROM orders GROUP BY o_custkey, o_orderstatus HAVING COUNT(*) > 1))
        SELECT * FROM found""",
    "ledger_rejects": sql(
        "txns",
        """SELECT id, concat_ws('; ', CASE WHEN amount <= 20000 THEN 'amount must be positive' END,
        CASE WHEN id % 40 = 0 THEN 'category_id is required' END, CASE WHEN payment_method = 'card' THEN 'unknown payment_method' END) AS reasons
        FROM txns WHERE amount <= 20000 OR id % 40 = 0 OR payment_method = 'card'""",
    ),
    "table_counts": sql(
        "walk",
        """SELECT 'transactions' AS "table", COUNT(*) AS row_count FROM txns
        UNION ALL SELECT 'budgets_total', COUNT(*) * 3 FROM customer UNION ALL SELECT 'budgets_per_category', COUNT(*) * 2 FROM customer
        UNION ALL SELECT 'budgets_envelope', COUNT(*) FROM customer UNION ALL SELECT 'pay_dates', COUNT(*) FROM walk
        UNION ALL SELECT 'savings_goals', COUNT(*) FROM customer""",
    ),
    "unexpected_part_types": """SELECT value, problem FROM (
        SELECT DISTINCT p_type AS value, 'unexpected' AS problem FROM part WHERE p_type NOT IN (SELECT c_mktsegment FROM customer)
        UNION ALL SELECT DISTINCT c_mktsegment, 'missing' FROM customer WHERE c_mktsegment NOT IN (SELECT p_type FROM part))""",
    "mismatched_types": """SELECT 'same' AS "check", 'lines' AS "table", 'status = line_status' AS "column", COUNT(*) AS violations
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END IS DISTINCT FROM CASE WHEN l_returnflag <> 'N' THEN l_linestatus END""",
}

# detection with confirmed dates: candidates outside their week, then the recursive walk
_DETECT = RELATIONS["txns"][1]
_DETECT = f"""WITH RECURSIVE txns AS ({_DETECT}),
confirmed AS (SELECT DISTINCT account_id, transaction_date AS d FROM txns WHERE amount >= 490000),
salaries AS (SELECT account_id, transaction_date AS d FROM txns WHERE category_id = '1-URGENT' AND amount >= 300000),
candidates AS (SELECT DISTINCT account_id, d FROM salaries s WHERE NOT EXISTS (
  SELECT 1 FROM confirmed c WHERE c.account_id = s.account_id AND c.d BETWEEN s.d - 7 AND s.d + 7)),
accepted AS (SELECT account_id, min(d) AS d FROM candidates GROUP BY account_id
  UNION ALL SELECT a.account_id, min(c.d) FROM accepted a JOIN candidates c ON c.account_id = a.account_id WHERE c.d > a.d + 7 GROUP BY a.account_id)
"""
ORACLE["detect_pay_dates"] = (
    _DETECT
    + "SELECT account_id, d AS pay_date, 'auto' AS source, 'Detected from Salary transaction' AS note FROM accepted"
)
ORACLE["detect_pay_dates_summary"] = (
    _DETECT
    + """SELECT account_id, COALESCE(a.n, 0) AS pay_dates_detected, s.n - COALESCE(a.n, 0) AS skipped_near_confirmed, s.n AS total_salary_transactions
    FROM (SELECT account_id, COUNT(*) AS n FROM salaries GROUP BY 1) s LEFT JOIN (SELECT account_id, COUNT(*) AS n FROM accepted GROUP BY 1) a USING (account_id)"""
)


def _quality() -> str:
    """Expected violations of the rules that the query's altered tables break, 0 for the rest."""
    period = "'payday', 'calendar', 'calendar_fallback'"
    t = "(SELECT t.*, amount - 2000 AS amt, CASE WHEN id % 100 = 0 THEN '0-NONE' ELSE category_id END AS cat, id - id % 1000 % 2 AS new_id FROM txns t)"
    b = "(SELECT b.*, CASE WHEN account_id % 5 = 0 THEN 'variable' ELSE type_id END AS typ FROM cbudgets b)"
    rows: list[tuple[str, str, str, str]] = []

    def add(table: str, check: str, *columns: str, count: str = "0") -> None:
        rows.extend((check, table, c, count) for c in columns)

    add("types", "not_null", "id", "name", "sort_order")
    add("types", "check", "unknown type", "sort_order out of range")
    add("types", "unique", "id", "name", "sort_order")
    add("categories", "not_null", "id", "name", "type_id")
    add("categories", "unique", "id", "name", "id, type_id")
    add("categories", "relationship", "type_id")
    add("transactions", "not_null", "id", "transaction_date", "category_id", "amount", "source")
    add("transactions", "check", "amount must be positive", count=f"(SELECT COUNT(*) FROM {t} WHERE amt <= 0)")
    add("transactions", "check", "unknown payment_method", count="(SELECT COUNT(*) FROM txns WHERE id % 61 = 0)")
    add("transactions", "check", "unknown source", "description too long", "raw_description too long")
    add(
        "transactions", "unique", "account_id, id",
        count=f"(SELECT COUNT(*) FROM (SELECT account_id, new_id FROM {t} GROUP BY ALL HAVING COUNT(*) > 1))",
    )
    add("transactions", "relationship", "category_id", count=f"(SELECT COUNT(*) FROM {t} WHERE cat = '0-NONE')")
    add(
        "transactions", "relationship", "transaction_date",
        count="(SELECT COUNT(*) FROM txns WHERE transaction_date < DATE '1995-02-01')",
    )
    add("transactions", "not_empty", "*")
    add("budgets", "not_null", "id", "type_id", "start_date", "end_date", "budget_amount")
    add("budgets", "check", "budget_amount must not be negative", "end_date must follow start_date")
    add("budgets", "unique", "account_id, id", "one active budget per category", "one active envelope per type")
    add("budgets", "relationship", "type_id")
    add(
        "budgets", "relationship", "category_id, type_id",
        count=f"(SELECT COUNT(*) FROM {b} WHERE category_id IS NOT NULL AND typ <> 'fixed')",
    )
    add("savings_goals", "not_null", "id", "name", "target_amount")
    add("savings_goals", "check", "target_amount must be positive", "current_amount must not be negative", "unknown status")
    add("savings_goals", "unique", "account_id, id")
    add("pay_dates", "not_null", "pay_date", "source")
    add("pay_dates", "check", "unknown source")
    add("pay_dates", "unique", "account_id, pay_date")
    add(
        "dim_date", "not_null", "date", "year", "month", "day", "day_of_week", "day_name", "month_name", "is_weekend",
        "quarter", "fiscal_year", "fiscal_month", "fiscal_month_label", "first_of_calendar_month", "first_of_fiscal_month",
    )
    add("dim_date", "unique", "date")
    add("fct_savings_rate", "not_null", "period_start_date", "period_label", "period_basis")
    add(
        "fct_savings_rate", "accepted_values", "period_basis",
        count=f"(SELECT COUNT(*) FROM pps WHERE period_basis NOT IN ({period}))",
    )
    add("fct_savings_rate", "unique", "account_id, period_start_date")
    parts = [
        f"SELECT '{check}' AS \"check\", '{table}' AS \"table\", '{column}' AS \"column\", CAST({count} AS BIGINT) AS violations"
        for check, table, column, count in rows
    ]
    return sql("pps cbudgets", " UNION ALL ".join(parts))


ORACLE["quality_report"] = _quality()
