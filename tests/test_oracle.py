"""Spark plans against the same rules on an independent engine, over the smallest tables."""

import collections
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _bag(rows, columns):
    return collections.Counter(tuple(None if v is None or v != v else int(v) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", ["line_rules_fused", "report_priority", "rule_c3", "rule_g7", "rule_h6", "rule_b2", "rule_b4", "rule_k4", "rule_j5", "rule_b6", *(f"rule_a{i}" for i in range(1, 9))])
def test_same_rows(spark, name):
    from riskloom.plans import queries

    got = [r.asDict() for r in queries.queries()[name](spark, SF).collect()]
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    assert got and sorted(columns) == sorted(got[0])
    assert _bag(got, sorted(columns)) == _bag(want, sorted(columns))


def test_every_query_has_sql():
    from riskloom.plans import queries

    assert set(queries.queries()) == set(queries.oracle_sql())
