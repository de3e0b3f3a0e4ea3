import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from remeasure.operators import spikes

RV = "obs_id long, targetid long, mjd double, vrad double, vrad_err double, ingested_at timestamp_ntz, value string, source string"
PAIRS = "pair_id long, group_id long, pair_z double"


def made(spark, rv=(), pairs=()):
    frame = spark.createDataFrame([(i, t, m, v, e, None, "x", "y") for i, t, m, v, e in rv], RV)
    return frame, spark.createDataFrame(list(pairs), PAIRS)


def brute(rv, pairs):
    """The definition of a case, reading by reading."""
    out = set()
    series = {}
    for i, t, m, v, e in sorted(set(rv), key=lambda r: (r[2], r[0])):
        for name, x in (("vrad", v), ("vrad_err", e)):
            if x is None or np.isnan(x):
                continue
            if np.isinf(x) or (name == "vrad" and abs(x) > 2000) or (name == "vrad_err" and x <= 0):
                out.add(("rvtab", name, i))
            if t is not None:
                series.setdefault(("rvtab", name, t), []).append((i, x))
    for i, g, z in sorted(set(pairs)):
        if z is None or np.isnan(z):
            continue
        if np.isinf(z):
            out.add(("pairs", "pair_z", i))
        if g is not None:
            series.setdefault(("pairs", "pair_z", g), []).append((i, z))
    for (table, name, _), values in series.items():
        finite = np.array([x for _, x in values if np.isfinite(x)])
        if len(finite) >= 8:
            lo, mid, hi = np.quantile(finite, [0.16, 0.5, 0.84])
            out |= {(table, name, i) for i, x in values if np.isfinite(x) and abs(x - mid) > 10 * (hi - lo) / 2}
        run = [values[0]]
        for item in [*values[1:], (None, None)]:
            if item[1] == run[0][1]:
                run.append(item)
                continue
            if len(run) >= 4:
                out |= {(table, name, i) for i, _ in run}
            run = [item]
    return out


def random_readings(seed, n=600):
    rng = np.random.default_rng(seed)
    rv = []
    for i in range(n):
        v = float(rng.normal(rng.integers(0, 3), 1))
        if rng.random() < 0.03:
            v += float(rng.choice([-40, 60, 500]))
        if rng.random() < 0.05:
            v = 7.5
        v = None if rng.random() < 0.02 else float("nan") if rng.random() < 0.02 else float("inf") if rng.random() < 0.01 else v
        e = float(rng.choice([0.5, 1.25, 0.75, 2.0])) if rng.random() > 0.02 else -1.0
        t = None if rng.random() < 0.05 else int(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]))
        rv.append((i, t, float(rng.integers(0, 200)), v, e))
    pairs = [(i, None if rng.random() < 0.05 else int(rng.integers(1, 12)), float(rng.normal() * (30 if rng.random() < 0.02 else 1))) for i in range(n)]
    return rv + rv[:20], pairs + pairs[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_cases_equal_the_definition(spark, seed):
    rv, pairs = random_readings(seed)
    found = {tuple(r) for r in spikes.cases(*made(spark, rv, pairs)).collect()}
    assert found == brute(rv, pairs)


def test_pieces_of_long_sources_give_the_same(spark, monkeypatch):
    rv, pairs = random_readings(3, 1500)
    whole = rows_of(spikes.cases(*made(spark, rv, pairs)))
    monkeypatch.setattr(spikes, "PIECE", 100)
    assert rows_of(spikes.cases(*made(spark, rv, pairs))) == whole


def test_a_source_of_fifty_thousand_readings(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(0, 1, 50_000) + np.where(np.arange(50_000) > 30_000, 3.0, 0.0)
    values[::701] += 80
    rv = [(i, 1, float(i), float(v), 1.0 + i / 1e6) for i, v in enumerate(values)]
    frames = made(spark, rv)
    assert {tuple(r) for r in spikes.cases(*frames).collect()} == brute(rv, [])


def test_one_fit_for_each_source(spark, monkeypatch):
    rng = np.random.default_rng(9)
    value = [0.0]
    for _ in range(999):
        value.append(0.6 * value[-1] + float(rng.normal()))
    value[100], value[400] = 50.0, float("inf")
    rv = [(i, 1, float(i), v, None) for i, v in enumerate(value)]
    monkeypatch.setattr(spikes, "PIECE", 150)
    rows = spikes.readings(*made(spark, rv)).where("source is not null")
    found = spikes._in_pieces(rows).where("field = 0").select("center", "spread", "phi", "scale", "n_finite").distinct().collect()
    x = np.array([v for v in value if np.isfinite(v)])
    seg, count = np.zeros(len(x), int), np.array([len(x)])
    low, center, high = np.quantile(x, [0.16, 0.5, 0.84])
    phi, scale = spikes._autoregression(x - center, seg, count, np.array([(high - low) / 2]))
    assert len(found) == 1 and np.allclose(found[0], (center, (high - low) / 2, phi[0], scale[0], len(x)), rtol=1e-6) and 0.5 < phi[0] < 0.7


def test_tests_go_on_until_nothing_stands_out():
    # 90 steps, each further than the last: many more passes than there were once
    x = np.concatenate([np.full(6, 3.0**k) for k in range(90)])
    seg, one = np.zeros(len(x), int), np.array([1.0])
    outlier, shifted = spikes._robust_ar_outliers(x, seg, one, np.array([0.0]), one, 3.5)
    assert (outlier | shifted)[12:].all()


def test_level_shift_is_no_spike(spark):
    rng = np.random.default_rng(0)
    rv = [(i, 1, float(i), float(rng.normal() + (30 if i >= 50 else 0)), 1.0 + i / 1000) for i in range(100)]
    flags = spikes.flag_readings(*made(spark, rv)).where("field_name = 'vrad'")
    assert flags.where("is_shifted").count() > 0 and flags.where("is_spike").count() == 0


def test_empty_tables_and_nulls(spark):
    assert spikes.cases(*made(spark)).count() == 0
    rows = spikes.cases(*made(spark, [(1, None, None, None, None), (2, None, None, 5000.0, 0.0), (None, 1, 1.0, 9999.0, 1.0)], [(1, None, None), (2, None, float("inf"))]))
    assert {tuple(r) for r in rows.collect()} == {("rvtab", "vrad", 2), ("rvtab", "vrad_err", 2), ("pairs", "pair_z", 2)}


def test_names_of_other_columns_dont_matter(spark):
    rv, pairs = random_readings(5, 100)
    a, b = made(spark, rv, pairs)
    extra = {c: F.lit("z") for c in ("field", "slot", "piece", "own", "n", "rec_id", "at", "center")}
    assert rows_of(spikes.cases(a.withColumns(extra), b.withColumns(extra))) == rows_of(spikes.cases(a, b))
