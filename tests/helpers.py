from collections import Counter


def rows(df, *columns):
    """Rows as a multiset, independent of order."""
    return Counter(map(tuple, df.select(*(columns or df.columns)).collect()))


def plan_text(df):
    return df._jdf.queryExecution().toString()
