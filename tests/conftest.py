import os
import sys
import tempfile
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from coffer.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, 4, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="coffer-test-")}
    )
    yield session
    session.stop()


def D(text):
    return date.fromisoformat(text)


def M(value):
    return Decimal(str(value)).quantize(Decimal("0.01"))


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


TXN = (
    "account_id string, id string, transaction_date date, category_id string, "
    "amount decimal(12,2)"
)


def txns(spark, data, account="a"):
    """(date, category, amount) or (account, date, category, amount) rows as transactions."""
    full = [r if len(r) == 4 else (account, *r) for r in data]
    return spark.createDataFrame(
        [(a, f"t{i}", D(d), c, M(x)) for i, (a, d, c, x) in enumerate(full)], TXN
    )


def pay_dates(spark, dates, account="a"):
    return spark.createDataFrame(
        [(account, D(d)) for d in dates], "account_id string, pay_date date"
    )


BUDGET = (
    "account_id string, id string, type_id string, category_id string, start_date date, "
    "end_date date, budget_amount decimal(12,2)"
)


def budgets(spark, data, account="a"):
    """(id, type, category, start, end, amount) rows as budget versions."""
    return spark.createDataFrame(
        [(account, i, t, c, D(s), D(e or "2030-01-01"), M(x)) for i, t, c, s, e, x in data], BUDGET
    )


@pytest.fixture(scope="session")
def dims(spark):
    from coffer.sources import seed_reference

    return seed_reference(spark)
