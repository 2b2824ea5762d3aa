"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_contract(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.columns == ["genre", "week_start", "rating_count", "avg_rating", "lag_1", "lag_2", "lag_3",
                          "rolling_3week_avg", "rolling_6week_avg", "is_synthetic"]
    assert df.count() > 0
    q, s = m.queries(), m.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100
    assert all(callable(f) for f in q.values()) and all(isinstance(x, str) and x.strip() for x in s.values())
