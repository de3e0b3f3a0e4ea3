"""Registered queries against their SQL counterparts on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest
from conftest import DATA

from remeasure.plans.queries import ORACLES, QUERIES

#: Quick ones of every kind; the others share their code.
NAMES = ["p1_found", "p4_found", "p4_by_night", "p4_by_tile", "adopted_velocity", "correction_coverage", "rejection_counts", "epoch_quality", "source_summary", "pair_table", "calibration_interday", "calibration_by_sn", "residual_histogram", "label_pair_sums", "pair_floors", "exposure_conflicts"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6) + 0.0
        return x

    return Counter(tuple(repr(cell(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    found = counted(ours.columns, [tuple(float(v) if str(type(v)).endswith("Decimal'>") else v for v in r) for r in ours.collect()])
    assert found == counted(names, theirs.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
