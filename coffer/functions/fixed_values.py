"""Fixed values of the ledger model.

Everything in this module is a constant that results depend on: names, limits, seed rows and
message formats. They are data, not logic, and every operator that uses one also accepts it as
a parameter.
"""

from datetime import date
from decimal import Decimal

# --- fixed values: dates and limits -------------------------------------------------------
ACTIVE_END = date(2030, 1, 1)  # end_date of a budget in force, end of the open pay period
CALENDAR_START = date(2025, 1, 1)
CALENDAR_END = date(2027, 12, 31)
FISCAL_SHIFT_DAYS = 13  # fiscal months start on the 14th
NEAR_LIMIT = Decimal("0.9")
SALARY_CATEGORY = "Salary"
SALARY_MIN_AMOUNT = Decimal("3000")
PAYDAY_GAP_DAYS = 7
WARNING_THRESHOLD = Decimal("0.90")
WARNING_THRESHOLD_MIN = Decimal("0.50")
WARNING_THRESHOLD_MAX = Decimal("1.0")
DEFAULT_PURCHASE_CATEGORY = "Shopping"
RECONCILE_TOLERANCE = Decimal("0.01")
PAGE_SIZE = 100
PAGE_SIZE_MAX = 1000
SEARCH_LIMIT = 10
LOCAL_TIMEZONE = "Australia/Sydney"
CURRENCY = "AUD"

# --- fixed values: enumerations -----------------------------------------------------------
TYPE_NAMES = ("fixed", "variable", "income", "saving")
EXPENSE_TYPES = ("fixed", "variable")
PAYMENT_METHODS = ("card", "cash", "transfer", "direct_debit")
TRANSACTION_SOURCES = ("manual", "bank_import")
PAY_DATE_SOURCES = ("auto", "manual")
GOAL_STATUSES = ("active", "completed", "paused")
PERIOD_MODES = ("payday", "calendar")
PERIOD_BASES = ("payday", "calendar", "calendar_fallback")
MART_STATUSES = ("over_budget", "near_budget", "within_budget")
GROUP_STATUSES = ("over", "near_limit", "on_track")
REPORT_STATUSES = ("over_budget", "near_budget", "on_track")

# --- fixed values: texts ------------------------------------------------------------------
NO_DESCRIPTION = "No description"
ALL_CATEGORIES_LABEL = "-- ALL --"
PAY_DATE_NOTE = "Detected from Salary transaction"
NO_BUDGET_REASON = (
    "No monthly budget is configured for %s or its %s expense envelope."
)
OVER_BUDGET_REASON = "The purchase would exceed the %s budget by $%s."
TIGHT_REASON = "The purchase fits, but would use %s%% of the %s budget."
WITHIN_BUDGET_REASON = "The purchase fits the %s budget with $%s remaining."

# --- fixed values: seed rows --------------------------------------------------------------
# (name, sort_order)
TYPES = (
    ("fixed", 1),
    ("variable", 2),
    ("income", 3),
    ("saving", 4),
)

# (name, type)
CATEGORIES = (
    ("Rent", "fixed"),
    ("Utilities", "fixed"),
    ("Phone & Internet", "fixed"),
    ("Insurance", "fixed"),
    ("Health", "fixed"),
    ("Subscriptions", "fixed"),
    ("Groceries", "variable"),
    ("Dining Out", "variable"),
    ("Transport", "variable"),
    ("Entertainment", "variable"),
    ("Shopping", "variable"),
    ("Personal Care", "variable"),
    ("Education", "variable"),
    ("Other Expense", "variable"),
    ("Salary", "income"),
    ("Freelance", "income"),
    ("Investment", "income"),
    ("Other Income", "income"),
    ("Emergency Fund", "saving"),
    ("Investment Savings", "saving"),
    ("Travel Fund", "saving"),
    ("General Savings", "saving"),
)

# (keyword, category, priority)
MERCHANT_RULES = (
    ("WOOLWORTHS", "Groceries", 10),
    ("COLES", "Groceries", 10),
    ("ALDI", "Groceries", 10),
    ("OPTUS", "Phone & Internet", 5),
    ("TELSTRA", "Phone & Internet", 5),
    ("NETFLIX", "Subscriptions", 5),
    ("SPOTIFY", "Subscriptions", 5),
    ("UBER", "Transport", 5),
    ("OPAL", "Transport", 5),
    ("LINKT", "Transport", 5),
    ("AMAZON", "Shopping", 3),
    ("KMART", "Shopping", 3),
    ("BUNNINGS", "Shopping", 3),
    ("CHEMIST", "Health", 3),
    ("MEDICARE", "Health", 3),
    ("GYM", "Health", 3),
    ("ENERGY", "Utilities", 5),
    ("AGL", "Utilities", 5),
    ("ORIGIN", "Utilities", 5),
)
