"""Small builders for test data."""

import datetime as dt


def d(text):
    return None if text is None else dt.date.fromisoformat(text)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
