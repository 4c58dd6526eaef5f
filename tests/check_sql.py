"""Run registered queries beside their SQL and report differences.

Usage: python tests/check_sql.py [--sf 0.01] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lumenframe.plans import catalog  # noqa: E402
from lumenframe.plans.inputs import TABLES  # noqa: E402


#: Queries without SQL, each with tests of its properties in the named file.
PROPERTY_TESTED = {
    "c06_approximate_recall": "test_near_trees.py", "c08_full_scores": "test_full_ensemble.py", "c13_full_top": "test_full_ensemble.py", "f09_stored_recall": "test_vector_index.py", "b13_full_profile": "test_profile.py", "c07_isolation_scores": "test_full_ensemble.py",
    "c12_full_ensemble": "test_full_ensemble.py", "d04_search": "test_tuning.py", "d05_refit": "test_models.py",
    "d06_holdout_accuracy": "test_models.py", "d09_class_importance": "test_models.py", "d11_clean_refit": "test_extra_trees.py",
}


def cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "∅nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """``(same, message)`` for one query."""
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if word in plan:
            return False, f"plan contains {word}"
    got_columns, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return name in PROPERTY_TESTED, f"{len(got)} rows, no SQL"
    result = con.execute(sql)
    want_columns, want = table_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return False, f"columns {got_columns} want {want_columns}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return False, f"{len(got)} rows want {len(want)}; extra {str(extra)[:400]} missing {str(missing)[:400]}"
    return True, f"{len(got)} rows"


def main():
    from lumenframe import build_session
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = catalog.oracle_sql()
    bad = 0
    for name, query in catalog.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            same, message = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as error:  # a broken query must not hide the others
            same, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not same
        print(f"{'ok  ' if same else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
