"""All three anomaly models: scores recomputed by SQL from the stored isolation trees and the SQL of the other two."""

import duckdb
import pandas as pd
import pytest

from lumenframe.operators import anomaly as an
from lumenframe.plans import anomalies as plans
from lumenframe.plans.inputs import TABLES, checking_sql

SF = "/root/testdata/sf0.001"

WALK = """WITH RECURSIVE u AS (SELECT id, i AS feature, x FROM cells),
  w AS (SELECT DISTINCT id, tree, 0 AS node FROM cells, (SELECT DISTINCT tree FROM nodes)
    UNION ALL SELECT w.id, w.tree, CASE WHEN u.x <= n.cut THEN n.l ELSE n.r END
    FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN u ON u.id = w.id AND u.feature = n.feature
    WHERE n.feature >= 0)
SELECT w.id, avg(n.path) AS depth FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE n.feature < 0 GROUP BY w.id"""


def nodes_of(trees):
    return pd.DataFrame([{"tree": t, "node": i, "feature": int(tree["feature"][i]), "cut": float(tree["cut"][i]),
                          "l": int(tree["left"][i]), "r": int(tree["right"][i]), "path": float(tree["path"][i])}
                         for t, tree in enumerate(trees) for i in range(len(tree["path"]))])


def depths(trees, matrix, key, features):
    """Mean depth of each row over all trees, walked by SQL."""
    nodes = nodes_of(trees)  # noqa: F841
    rows = matrix.select(key, *features).toPandas()
    cells = pd.concat([pd.DataFrame({"id": rows[key], "i": i, "x": rows[c]}) for i, c in enumerate(features)])  # noqa: F841
    return dict(duckdb.sql(WALK).fetchall())


def test_isolation_scores_by_sql(spark):
    """c07: the scores of the stored trees; each cut lies inside its node by the trees' own samples."""
    matrix = an.scaled_matrix(plans._rows(spark, SF).limit(300), "row_key", plans.FEATURES).persist()
    trees = an.isolation_trees(matrix, "row_key", plans.FEATURES, trees=12)
    found = depths(trees, matrix, "row_key", plans.FEATURES)
    got = an.isolation_scores(matrix, "row_key", plans.FEATURES, trees=12).collect()
    usual = an.average_path(trees[0]["rows"])
    assert len(got) == 300
    for r in got:
        assert r["isolation_score"] == pytest.approx(2 ** (-found[r["row_key"]] / usual))


def test_full_ensemble_by_sql(spark):
    """c08 to c13 with three models: min-max, mean, percentile, mix with the robust distance and the top ten."""
    matrix = plans._scaled_customers(spark, SF).persist()
    trees = an.isolation_trees(matrix, "c_custkey", plans.PARTS)
    usual = an.average_path(trees[0]["rows"])
    iso = pd.DataFrame([(k, 2 ** (-d / usual)) for k, d in depths(trees, matrix, "c_custkey", plans.PARTS).items()],  # noqa: F841
                       columns=["c_custkey", "i"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.register("iso", iso)
    sql = checking_sql(f"""WITH {plans._ENSEMBLE}, n3 AS (SELECT c_custkey, (i - MIN(i) OVER ()) / (MAX(i) OVER () - MIN(i) OVER ())
      AS i, h, k, s FROM iso JOIN ens USING (c_custkey)), e3 AS (SELECT *, (i + h + k) / 3 AS e3 FROM n3)
      SELECT c_custkey, i, h, k, e3, e3 * 0.7 + s * 0.3 AS hy, CASE WHEN e3 >= (SELECT QUANTILE_CONT(e3, 0.95) FROM e3) THEN 1
      ELSE 0 END AS label FROM e3""")
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    got = {r["c_custkey"]: r for r in plans.c08_full_scores(spark, SF).collect()}
    assert len(got) == len(want)
    for k, (i, h, n, e, hy, label) in want.items():
        r = got[k]
        assert [r["isolation_score"], r["histogram_score"], r["neighbour_score"], r["ensemble_score"], r["hybrid_score"]] == \
            pytest.approx([i, h, n, e, hy], abs=1e-7)
        assert r["label"] == label and r["severity"] == ("high" if hy >= 0.7 else "medium" if hy >= 0.4 else "low")
    top = sorted((k for k, v in want.items() if v[5]), key=lambda k: (-round(want[k][4], 8), k))[:10]
    assert [r["c_custkey"] for r in sorted(plans.c13_full_top(spark, SF).collect(), key=lambda r: (-r["hybrid_score"], r["c_custkey"]))] == top
    totals = an.anomaly_totals(an.anomaly_scores(plans._customers(spark, SF), "c_custkey")).first()
    assert totals["anomaly_count"] == sum(v[5] for v in want.values())
