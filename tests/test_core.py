"""The reference's own assertions and further cases, on inline tables."""

import gzip
import inspect
import json
import math
import struct

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from remeasure.functions.chi2 import log_upper_tail
from remeasure.functions.ranks import grouped_quantiles, numbered
from remeasure.operators import calibration, correction, label_offsets, pairs, quality, schema, summary, zero_points
from remeasure.operators.label_offsets import OffsetRules
from remeasure.plans import pipeline, report
from remeasure.sources import download, fits, readers


def test_success_words_and_numbers(spark):
    text = spark.createDataFrame([("1.0",), ("0.0",), ("Yes ",), ("2",), (None,)], "SUCCESS string")
    assert [r[0] for r in schema.coerce_types(text).collect()] == [True, False, True, False, False]
    numbers = spark.createDataFrame([(1.0,), (0.0,), (2.0,), (float("nan"),), (None,)], "SUCCESS double")
    assert [r[0] for r in schema.coerce_types(numbers).collect()] == [True, False, True, False, False]


def test_large_ids_stay_exact(spark):
    df = spark.createDataFrame([("123", "9007199254740993", "1", "1"), ("-5", None, "1", "1"), (None, "0", "1", "1"), ("7.0", "x", "1", "1")], "targetid string, source_id string, vrad string, vrad_err string")
    rows = schema.as_epochs(df).collect()
    assert [(r.GROUP_ID, r.GROUP_KIND) for r in rows] == [(9007199254740993, "GAIA_SOURCE_ID"), (5, "TARGETID_FALLBACK"), (0, "TARGETID_FALLBACK"), (-7, "TARGETID_FALLBACK")]


def test_names_aliases_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "` target_id ` long, radial_velocity double, vrad_err double, snr_r double")
    assert schema.normalize_columns(df).columns == ["TARGETID", "VRAD", "VRAD_ERR", "SN_R"]
    with pytest.raises(ValueError, match="VRAD_ERR"):
        schema.as_epochs(df.drop("vrad_err"))
    assert schema.context_of("a/rvpix_exp-main-dark.fits.gz") == ("MAIN", "DARK") and schema.context_of("x.fits") == (None, None)


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0, 20.0, 0, True), (2, 10.0, 1.0, 3.0, 0, True), (3, 10.0, 1.0, 20.0, 1, True), (4, None, -1.0, 20.0, None, None)], "TARGETID long, VRAD double, VRAD_ERR double, SN_R double, RVS_WARN int, SUCCESS boolean")
    assert [r.IS_GOOD for r in quality.with_quality(df).orderBy("TARGETID").collect()] == [True, False, False, False]
    counts = {r.REASON: r.N_REJECTED for r in quality.rejection_counts(df).collect()}
    assert counts == {"NONFINITE_RV": 1, "INVALID_RV_ERROR": 1, "EXTREME_ABS_RV": 0, "LOW_SN_R": 1, "FIT_NOT_SUCCESSFUL": 1, "RVS_WARNING": 2}
    assert {r.FRACTION for r in quality.rejection_counts(df.limit(0)).collect()} == {0.0}


def test_correction_applies_to_main_backup_only(spark):
    epochs = spark.createDataFrame([(1, "MAIN", "BACKUP", 100.0, 1.0), (1, "MAIN", "BRIGHT", 100.0, 1.0), (2, "main ", " backup", 100.0, 1.0)], "TARGETID long, SURVEY string, PROGRAM string, VRAD double, VRAD_ERR double")
    offsets = spark.createDataFrame([(1, 5.0)], "TARGETID long, VRAD_OFFSET double")
    out = correction.apply_velocity_calibration(epochs, offsets)
    assert sorted((r.TARGETID, r.PROGRAM.strip(), r.VRAD_ADOPTED) for r in out.collect()) == [(1, "BACKUP", 95.0), (1, "BRIGHT", 100.0), (2, "backup", 100.0)]
    assert tuple(correction.correction_coverage(out).first()) == (2, 1, 1, 1)
    with pytest.raises(ValueError, match="conflicting offsets"):
        correction.unique_correction(spark.createDataFrame([(1, 5.0), (1, 6.0)], "TARGETID long, VRAD_OFFSET double"))


def test_chi_square_tail():
    x, k = np.array([0.0, 23.9281, 33.3768, 72.2289, 1e5, 3.0, 5.0]), np.array([1, 1, 4, 24, 3, 2, 0])
    out = log_upper_tail(x, k)
    assert out[0] == 0 and np.allclose(np.exp(out[1:4]), 1e-6, rtol=1e-3) and np.isfinite(out[4]) and out[4] < -49000
    assert math.isclose(out[5], -1.5, rel_tol=1e-12) and np.isnan(out[6])
    assert abs(log_upper_tail(np.array([2_000_000.0]), np.array([2_000_000]))[0] - math.log(0.5)) < 0.01


def test_max_pair_sigma_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(rng.normal(0, 5)), float(rng.choice([0.5, 1, 2, 4]))) for g in range(6) for _ in range(g * 7)] + [(99, 1.0, 1.0)]
    found = {r.g: r.max_pair_sigma for r in summary.max_pair_sigma(spark.createDataFrame(rows, "g long, v double, e double"), "g", "v", "e").collect()}
    for g in range(1, 6):
        own = [(v, e) for k, v, e in rows if k == g]
        assert math.isclose(found[g], max(abs(a - b) / math.hypot(c, d) for a, c in own for b, d in own), rel_tol=1e-12)
    assert found[99] is None


def test_chi_square_of_fast_sources_keeps_its_digits(spark):
    rng = np.random.default_rng(3)
    v, e = 1e7 + rng.normal(0, 1e-3, 50), rng.uniform(5e-4, 2e-3, 50)
    df = spark.createDataFrame([(1, float(a), float(b), True) for a, b in zip(v, e)], "TARGETID long, VRAD double, VRAD_ERR double, IS_GOOD boolean")
    mean = np.average(v - 1e7, weights=e**-2)
    assert math.isclose(summary.summarize_sources(df).first().chi2_const, (((v - 1e7 - mean) / e) ** 2).sum(), rel_tol=1e-5)


def test_frontiers_where_error_grows_with_distance(spark, monkeypatch):
    monkeypatch.setattr(summary, "FRONTIER_PART", 100)
    rows = [(1, float(s * x), float(0.1 + x * x / 50)) for x in range(1, 200) for s in (1, -1)] + [(2, 5.0, 1.0)] * 3 + [(3, None, 1.0)]
    df = spark.createDataFrame(rows, "g long, v double, e double")
    found = {r.g: r.max_pair_sigma for r in summary.max_pair_sigma(df, "g", "v", "e").collect()}
    own = [(v, e) for g, v, e in rows if g == 1]
    assert math.isclose(found[1], max(abs(a - b) / math.hypot(c, d) for a, c in own for b, d in own), rel_tol=1e-12) and found[2] == 0.0 and 3 not in found


def test_variable_source_is_classified(spark):
    rows = [(42, 0.0, 0.5, 60000.0), (42, 20.0, 0.5, 60010.0), (42, -15.0, 0.5, 60020.0), (43, 1.0, 0.5, 60000.0), (44, None, 0.5, 60000.0)]
    df = quality.with_quality(spark.createDataFrame(rows, "TARGETID long, VRAD double, VRAD_ERR double, MJD double"))
    out = {r.targetid: r for r in summary.summarize_sources(df).collect()}
    assert out[42].classification == "candidate_variable" and out[42].max_pair_sigma > 5 and out[42].time_baseline_days == 20
    assert out[43].classification == "insufficient_epochs" and out[44].classification == "quality_limited" and out[44].chi2_const is None
    assert summary.candidates(summary.summarize_sources(df), strict=True).count() == 1


def test_pair_orientation_and_large_ids(spark):
    df = spark.createDataFrame([(5, 10.0, 1.0, "BRIGHT", 1.0), (5, 13.0, 1.0, "BACKUP", 2.0)], "TARGETID long, VRAD double, VRAD_ERR double, PROGRAM string, MJD double")
    row = pairs.epoch_pairs(df).first()
    assert (row.PROGRAM_PAIR, row.PROGRAM_DELTA_VRAD) == ("BACKUP / BRIGHT", 3.0) and math.isclose(row.PROGRAM_PAIR_Z, 3 / math.sqrt(2))
    big = spark.createDataFrame([(2**53 + 1, 2**53 + 1, 2**53 + 1, float(k), 1.0, float(k)) for k in (1, 2)], "GROUP_ID long, TARGETID long, SOURCE_ID long, VRAD double, VRAD_ERR double, MJD double")
    row = pairs.epoch_pairs(big).first()
    assert (row.GROUP_ID, row.SOURCE_ID_1, row.TARGETID_2) == (2**53 + 1,) * 3
    assert len(pairs.epoch_pairs(big).columns) == 44


@pytest.mark.parametrize("cap", [0, 1, 2, 5, 20, 50])
def test_capped_places_equal_linspace(spark, cap):
    sizes = [2, 3, 7, 11, 16, 40]
    df = spark.createDataFrame([(n, n) for n in sizes], "GROUP_ID long, group_size long")
    if cap == 0:
        epochs = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 2.0)], "TARGETID long, VRAD double, VRAD_ERR double, MJD double")
        assert pairs.epoch_pairs(epochs, 0).count() == 0
        return
    found = {}
    for r in pairs.pair_places(df, cap).collect():
        found.setdefault(r.GROUP_ID, []).append((r.pair_no, r.i, r.j))
    for n in sizes:
        every = list(zip(*np.triu_indices(n, 1)))
        at = range(len(every)) if len(every) <= cap else np.linspace(0, len(every) - 1, cap, dtype=int)
        assert sorted(found[n]) == [(int(p), int(every[p][0]), int(every[p][1])) for p in at]


@pytest.mark.parametrize("n", [10**9, 3 * 10**9 + 7, 33 * 10**10])
def test_places_in_huge_groups_are_exact(spark, n):
    rows = pairs.pair_places(spark.createDataFrame([(1, n)], "GROUP_ID long, group_size long"), 50).collect()
    assert len(rows) == 50 and (rows[0].i, rows[0].j) == (0, 1)
    for r in rows:
        assert 0 <= r.i < r.j < n and r.i * (2 * n - r.i - 1) // 2 + r.j - r.i - 1 == int(r.pair_no)
    assert max(int(r.pair_no) for r in rows) == n * (n - 1) // 2 - 1


def test_default_cap_is_that_of_the_reference(spark):
    from remeasure.__main__ import parser

    # 12 epochs have 66 pairs, 8 have 28: more than 20 of both are made, and all of the smaller group
    rows = [(g, 1.0 * k, 1.0, 1.0 * k) for g, n in ((1, 12), (2, 8)) for k in range(n)]
    epochs = spark.createDataFrame(rows, "TARGETID long, VRAD double, VRAD_ERR double, MJD double")
    assert {r.GROUP_ID: r["count"] for r in pairs.epoch_pairs(epochs).groupBy("GROUP_ID").count().collect()} == {1: 50, 2: 28}
    assert inspect.signature(pipeline.run_audit).parameters["cap"].default == 50
    assert parser().parse_args(["analyze", "x.csv", "--output", "y"]).cap == 50


def test_quantiles_of_large_groups_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k in (None, 1, 2) for v in rng.normal(0, 1, 900 if k != 2 else 30)] + [(1, 0.25)] * 400 + [(1, None), (1, float("nan")), (3, float("inf"))]
    df = spark.createDataFrame(rows, "k long, v double")
    out = {r.k: (r.a, r.b, r.c) for r in grouped_quantiles(df, ["k"], "v", {"a": 0.16, "b": 0.5, "c": 0.99}, whole=100).collect()}
    assert set(out) == {None, 1, 2}
    for k, got in out.items():
        own = [v for g, v in rows if g == k and v is not None and math.isfinite(v)]
        assert np.allclose(got, np.quantile(own, [0.16, 0.5, 0.99]))


def test_numbered_over_slots(spark):
    df = spark.createDataFrame([(1, float(m), x) for m, x in [(3, 1), (1, 2), (1, 1), (2, 1)]] + [(1, None, 1)], "g long, m double, x long")
    out = {(r.m, r.x): (r.place, r.group_size) for r in numbered(df, ["g"], F.floor("m"), [F.asc_nulls_last("m"), F.col("x")]).collect()}
    assert out == {(1.0, 1): (0, 5), (1.0, 2): (1, 5), (2.0, 1): (2, 5), (3.0, 1): (3, 5), (None, 1): (4, 5)}


def test_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,), (None,)], "SN_R_MIN double")
    out = calibration.add_quantile_bin(df, "SN_R_MIN")
    assert out.where("SN_R_MIN_BIN is null").count() == 1
    assert calibration.add_quantile_bin(df.where("SN_R_MIN = 1"), "SN_R_MIN").first().SN_R_MIN_BIN == "all"


def label_pairs(spark, groups=360, nights=6):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(groups):
        i, j = rng.choice(nights, 2, replace=False)
        d = 0.45 * (i - 2.5) - 0.45 * (j - 2.5) + 0.03 * ((g % 5) - 2)
        rows.append((g + 1, float(d), 0.8, 0.2, "BACKUP", "BACKUP", f"2021010{i}", f"2021010{j}", "BACKUP / BACKUP", 2.0, f"MAIN|BACKUP|{i}", f"MAIN|BACKUP|{j}"))
    return spark.createDataFrame(rows, "GROUP_ID long, DELTA_VRAD double, PAIR_ERROR double, PAIR_ERROR_FORMAL double, PROGRAM_1 string, PROGRAM_2 string, NIGHT_1 string, NIGHT_2 string, PROGRAM_PAIR string, DELTA_DAYS double, EXPOSURE_KEY_1 string, EXPOSURE_KEY_2 string")


def test_label_offsets_narrow_held_out_pairs(spark):
    rules = OffsetRules(folds=2, min_pairs_per_label=10, damp=0.01)
    out = label_offsets.run_experiment(label_pairs(spark), rules, permutations=1)
    rows = out["summary"].collect()
    assert len(rows) == 2 and all(r.raw_width_after < r.raw_width_before for r in rows)
    half = out["reproducibility"].first()
    assert half.n_labels == 6 and half.correlation > 0.95
    assert out["permutations"].count() == 2


def test_twenty_permutations_by_default(spark, monkeypatch):
    from conftest import DATA

    from remeasure.__main__ import parser
    from remeasure.plans.queries import QUERIES

    assert parser().parse_args(["analyze", "x.csv", "--output", "y"]).permutations == 20
    assert inspect.signature(pipeline.run_audit).parameters["permutations"].default == 20
    seeds = []
    monkeypatch.setattr(label_offsets, "exposure_nights", lambda df, s, f=label_offsets.exposure_nights: seeds.append(s) or f(df, s))
    monkeypatch.setattr(label_offsets, "run_folds", lambda prepared, *_: {name: prepared for name in ("summary", "by_program", "offsets")})
    monkeypatch.setattr(label_offsets, "half_reproducibility", lambda prepared, *_: prepared)
    shuffled = label_offsets.run_experiment(label_pairs(spark))["permutations"]
    assert shuffled.select("permutation").distinct().count() == 20
    QUERIES["permutation_control"](spark, DATA)
    assert seeds == [list(range(20))] * 2


def test_solution_meets_the_normal_equations():
    import pandas as pd

    rng = np.random.default_rng(4)
    labels = [f"n{k}" for k in range(8)]
    every = [(a, b) for k, a in enumerate(labels) for b in labels[k + 1 :]]
    sums = pd.DataFrame(every, columns=["L1", "L2"]).assign(s0=rng.random(len(every)), s1=rng.normal(size=len(every)), s2=9.0, n=3)
    x = label_offsets.solve_sums(sums, 0.2, False).set_index("label")["offset"]
    gap = {n: 0.0 for n in labels}
    shift = 0.0
    for r in sums.itertuples():
        rest = r.s1 - r.s0 * (x[r.L1] - x[r.L2])
        gap[r.L1] += rest
        gap[r.L2] -= rest
    # the damped solution sums to 0, so the centred one is off by one constant
    values = np.array([gap[n] - 0.04 * x[n] for n in labels])
    assert np.allclose(values, values.mean(), atol=1e-9)


def random_sums(n, links, seed):
    import pandas as pd

    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, links), rng.integers(0, n, links)
    low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    rows = pd.DataFrame({"L1": [f"n{k:06d}" for k in low], "L2": [f"n{k:06d}" for k in high], "s0": rng.random(len(low)) + 0.1, "s1": rng.normal(size=len(low)), "s2": 1.0, "n": 1})
    return rows.groupby(["L1", "L2"], as_index=False).sum()


@pytest.mark.parametrize("damp", [0.2, 0.0])
def test_thirty_thousand_labels_in_one_task(damp):
    sums = random_sums(30_000, 90_000, 7)
    out = label_offsets.solve_sums(sums, damp, False)
    assert len(out) > 29_000
    x = out.set_index("label")["offset"]
    rest = sums["s1"].to_numpy() - sums["s0"].to_numpy() * (x[sums["L1"]].to_numpy() - x[sums["L2"]].to_numpy())
    gap = np.bincount(np.searchsorted(out["label"], sums["L1"]), rest, len(out)) - np.bincount(np.searchsorted(out["label"], sums["L2"]), rest, len(out))
    assert np.abs(gap - damp**2 * x.to_numpy()).max() < 1e-7


@pytest.mark.parametrize("damp", [0.2, 0.0])
def test_rounds_of_joins_give_the_same_solution(spark, monkeypatch, damp):
    import pandas as pd

    models = [random_sums(40, 70, k).assign(run=0, m=k) for k in (0, 1)]
    rules = OffsetRules(damp=damp)
    sums = spark.createDataFrame(pd.concat(models)[["run", "m", "L1", "L2", "s0", "s1", "s2", "n"]])
    found = {(r.m, r.label): (r.offset, r.component) for r in label_offsets._solved_in_rounds(sums, rules).collect()}
    for k, own in enumerate(models):
        for r in label_offsets.solve_sums(own, damp, True).itertuples():
            offset, component = found.pop((k, r.label))
            assert abs(offset - r.offset) < 1e-7 and component == r.component
    assert not found


def test_large_models_are_solved_in_rounds(spark, monkeypatch):
    rules = OffsetRules(folds=2, min_pairs_per_label=10, damp=0.01, clip_rounds=1)
    rows = label_offsets.prepare(label_pairs(spark), rules)
    few = rows_of(label_offsets.run_folds(rows, rules)["offsets"].selectExpr("fold", "label", "round(offset, 5)", "component"))
    monkeypatch.setattr(label_offsets, "LOCAL_SUMS", 3)
    assert rows_of(label_offsets.run_folds(rows, rules)["offsets"].selectExpr("fold", "label", "round(offset, 5)", "component")) == few and len(few) == 12


def test_folds_that_cant_be_scored(spark):
    rules = OffsetRules(folds=3, min_pairs_per_label=10_000)
    out = label_offsets.run_folds(label_offsets.prepare(label_pairs(spark), rules), rules)
    rows = out["summary"].collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and all((r.n_labels, r.n_holdout_same_component, r.raw_width_before) == (0, 0, None) for r in rows)
    assert sum(r.n_holdout_cross_component for r in rows) == 360 and out["by_program"].count() == 0 and out["offsets"].count() == 0
    assert label_offsets.half_reproducibility(label_offsets.prepare(label_pairs(spark), rules), rules).count() == 0


def test_shuffles_move_something_and_conflicts_raise(spark):
    columns = "EXPOSURE_KEY_1 string, PROGRAM_1 string, NIGHT_1 string, EXPOSURE_KEY_2 string, PROGRAM_2 string, NIGHT_2 string"
    df = spark.createDataFrame([("a", "DARK", "1", "b", "DARK", "2"), ("c", "BRIGHT", "3", "c", "BRIGHT", "3")], columns)
    seeds = list(range(8))
    for seed in seeds:
        own = {r.EXPOSURE_KEY: r.NIGHT for r in label_offsets.exposure_nights(df, seeds).where(f"seed = {seed}").collect()}
        assert own == {"a": "2", "b": "1", "c": "3"}  # two exposures always change places
    torn = label_pairs(spark).withColumn("NIGHT_1", F.when(F.col("GROUP_ID") == 1, "19990101").otherwise(F.col("NIGHT_1")))
    with pytest.raises(ValueError, match="several nights"):
        label_offsets.permutation_control(torn, 1, OffsetRules(folds=2, min_pairs_per_label=10))


def test_one_night_for_each_exposure_after_shuffling(spark):
    df = label_pairs(spark)
    nights = label_offsets.exposure_nights(df, [0, 1]).collect()
    for seed in (0, 1):
        own = {r.EXPOSURE_KEY: r.NIGHT for r in nights if r.seed == seed}
        assert len(own) == 6 and sorted(own.values()) == [f"2021010{k}" for k in range(6)]


def test_zero_points(spark):
    rows = [(g, (2.0 if g % 2 else -2.0) + 0.01 * ((g % 5) - 2), 1.0, 2.0 if g % 2 else -2.0, *(("A", "B") if g % 2 else ("B", "A")), "A / B", 2.0) for g in range(400)]
    df = spark.createDataFrame(rows, "GROUP_ID long, DELTA_VRAD double, PAIR_ERROR double, PAIR_Z double, PROGRAM_1 string, PROGRAM_2 string, PROGRAM_PAIR string, DELTA_DAYS double")
    rules = OffsetRules(min_pairs_per_label=10, damp=0.01, balance_groups=False, center_components=False)
    out = zero_points.zero_point_calibration(df, ["PROGRAM", "NO_SUCH"], rules)
    row = out["summary"].first()
    assert row.width_z_after < 0.1 * row.width_z_before and out["by_program"].count() == 1
    with pytest.raises(ValueError):
        zero_points.estimate_zero_points(df, "NO_SUCH")


def test_zero_points_keep_labels_and_null_groups(spark):
    # C is only paired with itself: kept, without an equation; the null group is one source
    rows = [(None if g % 7 == 0 else g, 2.0 if g % 2 else -2.0, 1.0, 2.0 if g % 2 else -2.0, *(("A", "B") if g % 2 else ("B", "A")), 2.0) for g in range(400)]
    rows += [(g, 0.5, 1.0, 0.5, "C", "C", 2.0) for g in range(1000, 1100)] + [(g, 90.0, 1.0, 90.0, "D", "A", 2.0) for g in range(2000, 2100)]
    df = spark.createDataFrame(rows, "GROUP_ID long, DELTA_VRAD double, PAIR_ERROR double, PAIR_Z double, PROGRAM_1 string, PROGRAM_2 string, DELTA_DAYS double")
    rules = OffsetRules(min_pairs_per_label=10, damp=0.0, balance_groups=False, center_components=False)
    out = zero_points.zero_point_calibration(df, ["program", "FIBER"], rules)
    offsets = {r.label: (round(r.offset, 6), r.n_endpoints > 0) for r in out["offsets"].collect()}
    # D has only pairs beyond 5 errors: they left before labels were counted
    assert offsets == {"A": (1.0, True), "B": (-1.0, True), "C": (0.0, True)}
    row = out["summary"].first()
    assert row.n_labels == 3 and row.max_abs_offset == 1.0
    split = df.select((label_offsets.hashed(F.coalesce(F.col("GROUP_ID").cast("string"), F.lit("")), 1000) < 500).alias("t"), "GROUP_ID").collect()
    assert row.n_holdout_pairs == sum(not r.t for r in split) and any(r.GROUP_ID is None for r in split)
    few = zero_points.estimate_zero_points(df, "PROGRAM", OffsetRules(min_pairs_per_label=10_000))
    row = few["summary"].first()
    assert (row.n_labels, row.delta_width_z, few["offsets"].count(), few["by_program"].count()) == (0, 0.0, 0, 0) and row.width_z_after == row.width_z_before


def fits_file(path, tables):
    """A minimal file: tables is a list of (name, [(column, code, values)])."""

    def header(cards):
        text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    out = header([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)])
    for name, columns in tables:
        n = len(columns[0][2])
        pack = lambda c, v: v.encode().ljust(int(c[:-1])) if c.endswith("A") else (b"T" if v else b"F") if c == "L" else struct.pack({"K": ">q", "D": ">d", "J": ">i"}[c], v)
        rows = [b"".join(pack(c, v[i]) for _, c, v in columns) for i in range(n)]
        width = len(rows[0])
        cards = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)), ("EXTNAME", f"'{name}'")]
        for k, (c, code, _) in enumerate(columns, 1):
            cards += [(f"TTYPE{k}", f"'{c}'"), (f"TFORM{k}", f"'{code}'")]
        data = b"".join(rows)
        out += header(cards) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wb") as f:
        f.write(out)


def fits_tables(second=(1, 2)):
    rv = [("TARGETID", "K", [1, 2**53 + 1]), ("VRAD", "D", [1.5, -2.5]), ("VRAD_ERR", "D", [1.0, 1.0]), ("SN_R", "D", [9.0, 9.0]), ("RVS_WARN", "K", [0, 0]), ("SUCCESS", "L", [True, False]), ("EXPID", "K", [7, 8]), ("FIBER", "K", [3, 4]), ("VSINI", "D", [1.0, 1.0]), ("RR_SPECTYPE", "4A", ["STAR", "QSO"])]
    fm = [("TARGETID", "K", list(second)), ("EXPID", "K", [7, 8]), ("FIBER", "K", [3, 4]), ("MJD", "D", [59000.5, 59001.5]), ("NIGHT", "K", [20210101, 20210102]), ("FIBERSTATUS", "J", [0, 1]), ("TILEID", "K", [5, 6])]
    return [("RVTAB", rv), ("FIBERMAP", fm), ("GAIA", [("SOURCE_ID", "K", [10, -1])])]


@pytest.mark.parametrize("name", ["rvpix_exp-main-dark.fits", "rvpix_exp-main-dark.fits.gz"])
def test_fits_reading(spark, tmp_path, name):
    path = str(tmp_path / name)
    fits_file(path, fits_tables((1, 2**53 + 1)))
    rows = readers.read_epochs(spark, path, strict=True).orderBy("ROW_ID").collect()
    assert [(r.TARGETID, r.VRAD, r.MJD, r.SUCCESS, r.RR_SPECTYPE, r.SURVEY, r.PROGRAM, r.GROUP_ID) for r in rows] == [
        (1, 1.5, 59000.5, True, "STAR", "MAIN", "DARK", 10), (2**53 + 1, -2.5, 59001.5, False, "QSO", "MAIN", "DARK", -(2**53 + 1)),
    ]
    fits.register(spark)
    parts = spark.read.format("fits_table").option("path", path).option("rowsPerPartition", "1").load()
    assert parts.rdd.getNumPartitions() == 2 and parts.count() == 2
    assert readers.read_epochs(spark, path, max_rows=1).count() == 1


def test_fits_alignment_and_strictness(spark, tmp_path):
    path = str(tmp_path / "x.fits")
    fits_file(path, fits_tables((1, 9)))
    with pytest.raises(Exception, match="row-alignment mismatch"):
        readers.read_epochs(spark, path).collect()
    fits_file(path, [fits_tables()[0], fits_tables()[2]])
    with pytest.raises(Exception, match="FIBERMAP"):
        readers.read_epochs(spark, path, strict=True).collect()


def test_files_by_suffix_and_union(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TARGETID,VRAD,VRAD_ERR\n1,10,1\n2,x,1\n")
    spark.createDataFrame([(3, 1.0, 2.0, "DARK")], "targetid long, vrad double, vrad_err double, program string").write.parquet(str(tmp_path / "b.parquet"))
    df = readers.read_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.parquet")])
    assert sorted((r.TARGETID, r.VRAD, r.PROGRAM) for r in df.where("VRAD is not null").collect()) == [(1, 10.0, None), (3, 1.0, "DARK")]
    with pytest.raises(ValueError):
        readers.read_epochs(spark, "x.txt")
    with pytest.raises(ValueError):
        readers.read_many(spark, [])


def test_audit_from_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(t, float(rng.normal(0, 1) + (40 * rng.random() if t <= 10 else 0)), 1.0, 59000.0 + k, 20.0, "MAIN", "DARK" if k % 2 else "BRIGHT") for t in range(1, 41) for k in range(6)]
    df = schema.as_epochs(spark.createDataFrame(rows, "TARGETID long, VRAD double, VRAD_ERR double, MJD double, SN_R double, SURVEY string, PROGRAM string"))
    audit = pipeline.run_audit(df)
    flagged = {r.targetid for r in audit.tables["source_summary"].where("classification = 'candidate_variable'").collect()}
    assert len(flagged & set(range(1, 11))) >= 8 and len(flagged - set(range(1, 11))) <= 2
    names = pipeline.save(audit, str(tmp_path), lite=True)
    assert "pairs" not in names and "candidate_sources" in names
    assert pipeline.read_saved(spark, str(tmp_path), "rejection_counts").count() == 4 and pipeline.read_saved(spark, str(tmp_path), "pairs") is None
    report.write_report(audit.tables, str(tmp_path / "r.md"))
    text = (tmp_path / "r.md").read_text()
    assert "## Sources by class" in text and "No pairs join backup" in text
    assert report.shown(1234567, "N_PAIRS") == "1,234,567" and report.shown(float("nan")) == "n/a" and report.shown(0.5, "FRACTION") == "0.50000"


def test_manifest(tmp_path, monkeypatch):
    path = tmp_path / "in.csv"
    path.write_text("TARGETID,VRAD,VRAD_ERR\n1,10,1\n")
    monkeypatch.setenv("REMEASURE_REVISION", "abc")
    pipeline.write_manifest(pipeline.manifest([str(path)], {"cap": 20}, argv=["x"]), str(tmp_path / "m.json"))
    out = json.loads((tmp_path / "m.json").read_text())
    assert out["revision"] == "abc" and out["inputs"][0]["bytes"] == path.stat().st_size and out["parameters"] == {"cap": 20}


class Answer:
    def __init__(self, data, status):
        self.data, self.status = data, status

    def read(self, n):
        out, self.data = self.data[:n], self.data[n:]
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


@pytest.mark.parametrize("ranges", [True, False])
def test_download_resumes_or_starts_anew(tmp_path, ranges):
    content = b"0123456789"

    def opener(request):
        start = int(request.headers.get("Range", "bytes=0-")[6:-1]) if ranges else 0
        return Answer(content[start:], 206 if start else 200)

    (tmp_path / "f.part").write_bytes(content[:4])
    out = download.fetch(download.RemoteFile("http://x/f", "f", 10), tmp_path, opener=opener)
    assert out.read_bytes() == content
    with pytest.raises(ValueError, match="bytes"):
        download.fetch(download.RemoteFile("http://x/g", "g", 11), tmp_path, opener=opener)
