"""Run every query next to its SQL and report differences. Usage: check_oracle.py FOLDER [name...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from fareloom.plans.catalog import all_queries  # noqa: E402
from fareloom.plans.oracle import all_sql  # noqa: E402

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def plain(value):
    if value is None:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, list):
        return tuple(value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows),
                  key=lambda r: [(v is None, str(type(v)) if isinstance(v, (str, tuple)) else "",
                                  str(v) if not isinstance(v, (int, float)) else "",
                                  round(v, 4) if isinstance(v, (int, float)) else 0) for v in r])


def same(a, b, digits):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b if digits is None else math.isclose(a, b, rel_tol=10 ** -digits, abs_tol=1e-9)
    return a == b


def compare(spark, folder, name, con):
    """(problem or None, whether the values are bit-identical, seconds)"""
    started = time.time()
    df = all_queries()[name](spark, folder)
    ours = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if name not in all_sql():
        return None, None, seconds
    result = con.execute(all_sql()[name])
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", False, seconds
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}", False, seconds
    left, right = rows_of(df.columns, ours), rows_of(columns, theirs)
    exact = True
    for a, b in zip(left, right):
        for column, x, y in zip(sorted(columns), a, b):
            if not same(x, y, 9):
                return f"{column}: {x!r} / {y!r} in {a} / {b}", False, seconds
            exact = exact and same(x, y, None)
    return None, exact, seconds


def connect(folder):
    con = duckdb.connect()
    for name in NAMES:
        path = os.path.join(folder, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


if __name__ == "__main__":
    from fareloom.session import build_session

    session = build_session("local[8]", 8, **{"spark.ui.enabled": "false",
                                              "spark.driver.memory": "12g"})
    session.sparkContext.setLogLevel("OFF")
    connection = connect(sys.argv[1])
    for query in sys.argv[2:] or list(all_queries()):
        try:
            problem, exact, seconds = compare(session, sys.argv[1], query, connection)
            state = "no SQL" if exact is None else "exact" if exact else "close"
            print(f"{query:36s} {seconds:6.1f}s {'DIFF ' + problem[:400] if problem else state}",
                  flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{query:36s} FAIL {str(error)[:500]}", flush=True)
