"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from marketflow import registry
from marketflow.plans import audit_queries, cascade_queries, economics_queries, evaluation_queries, event_queries, feature_queries, manifest_queries, probe_queries, regime_queries, silver_queries, stream_queries, study_queries, validation_queries, window_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(([plain(r[c]) for c in order] for r in rows), key=repr)
    theirs = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in order] for r in found.fetchall()), key=repr)
    assert ours == theirs
