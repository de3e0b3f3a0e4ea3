from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from remeasure.operators import references

RV = "obs_id long, targetid long, survey string, program string, night long, tileid long, ingested_at timestamp_ntz"
REF = "targetid long, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
DAY = datetime(2021, 5, 1)


def at(hours):
    return None if hours is None else DAY + timedelta(hours=hours)


def made(spark, rv, gaia, corr):
    return (
        spark.createDataFrame([(o, t, s, p, 20210501, 7, at(h)) for o, t, s, p, h in rv], RV),
        spark.createDataFrame([(t, at(a), at(b)) for t, a, b in gaia], REF),
        spark.createDataFrame([(t, at(a), at(b)) for t, a, b in corr], REF),
    )


def brute(rv, gaia, corr):
    first = {}
    for o, t, s, p, h in sorted(rv, key=lambda r: r[4]):
        first.setdefault(o, (t, s, p, h))
    out = set()
    for o, (t, s, p, h) in first.items():
        if t is None:
            continue
        tables = [("gaia", gaia)]
        if (s or "").strip().upper() == "MAIN" and (p or "").strip().upper() == "BACKUP":
            tables.append(("backup_correction", corr))
        for name, rows in tables:
            if not any(k == t and a is not None and a <= h and (b is None or h < b) for k, a, b in rows):
                out.add((name, o))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_orphans_equal_the_definition(spark, seed):
    r = Random(seed)
    span = lambda: (r.randrange(0, 200), r.choice([None, r.randrange(0, 240)]))
    rv = [(r.randrange(60), r.choice([None, 1, 1, 1, 2, 3, 4, 5, 99]), r.choice(["MAIN", " main", "SV3", None]), r.choice(["BACKUP", "backup ", "DARK", None]), h) for h in r.sample(range(240), 120)]
    gaia = [(r.choice([1, 2, 3, None]), *span()) for _ in range(12)]
    corr = [(r.choice([1, 2, 4, 77]), *span()) for _ in range(12)]
    # a redelivered observation keeps its target
    target = {}
    rv = [(o, target.setdefault(o, t), s, p, h) for o, t, s, p, h in rv]
    found = {tuple(x) for x in references.orphans(*made(spark, rv, gaia, corr + corr[:3])).collect()}
    assert found == brute(rv, gaia, corr)


def test_edges_of_force(spark):
    rv = [(1, 5, "MAIN", "DARK", 10), (2, 5, "MAIN", "DARK", 20), (3, 5, "MAIN", "DARK", 9), (4, None, "MAIN", "DARK", 9)]
    found = references.orphans(*made(spark, rv, [(5, 10, 20)], [])).collect()
    assert {tuple(x) for x in found} == {("gaia", 2), ("gaia", 3)}


def test_empty_tables_and_clashing_names(spark):
    assert references.orphans(*made(spark, [], [], [])).count() == 0
    rv, gaia, corr = made(spark, [(1, 5, "MAIN", "BACKUP", 10)], [(5, 1, None)], [])
    extra = {c: F.lit("x") for c in ("key", "day", "until", "ref_table", "at", "known", "late")}
    tables = [df.withColumns(extra) for df in (rv, gaia, corr)]
    assert [tuple(r) for r in references.orphans(*tables).collect()] == [("backup_correction", 1)]
    counts = references.orphans_by_night(*tables).collect()
    assert {(r.ref_table, r.n_references, r.n_orphans, r.n_unknown) for r in counts} == {("gaia", 1, 0, 0), ("backup_correction", 1, 1, 1)}
