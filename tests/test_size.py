"""Paths that only large tables take, on small ones."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from remeasure.functions import ranks
from remeasure.operators import label_offsets, zero_points
from remeasure.operators.label_offsets import OffsetRules


def test_a_run_is_solved_batch_by_batch(monkeypatch):
    monkeypatch.setattr(label_offsets, "_CHUNK", 7)
    rng = np.random.default_rng(7)
    labels = [f"n{k:02}" for k in rng.permutation(30)]
    every = [(m, a, b) for m in (0, 1) for k, a in enumerate(labels) for b in labels[k + 1 :] if rng.random() < 0.2 and (a < "n10") == (b < "n10")]
    sums = pd.DataFrame(every, columns=["m", "L1", "L2"]).assign(run=3, s0=rng.random(len(every)), s1=rng.normal(size=len(every)))
    batches = pa.Table.from_pandas(sums, preserve_index=False).to_batches(max_chunksize=13)
    found = pa.Table.from_batches(label_offsets._run_solver(2, OffsetRules(), "int")(iter(batches))).to_pylist()
    assert [r["label"] for r in found] == sorted(set(sums["L1"]) | set(sums["L2"]))
    for m, own in sums.groupby("m"):
        got = {r["label"]: (r["o"][m], r["c"][m]) for r in found if r["o"][m] is not None}
        wanted = {r.label: (r.offset, r.component) for r in label_offsets.solve_sums(own, 0.2, True).itertuples()}
        assert got.keys() == wanted.keys()
        assert all(abs(got[k][0] - x) < 1e-9 and got[k][1] == c for k, (x, c) in wanted.items())
    # rounds of joins took hours from 2,000,000 rows on, which the exposures of a gigabyte exceed
    assert label_offsets.LOCAL_SUMS >= 10_000_000


def test_quantiles_are_exact_whatever_the_sketch_says(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.randn(1).alias("_v0"), F.when(F.col("id") % 3 == 1, F.round(F.randn(2), 1)).alias("_v1"))
    df = ranks.stored(df)
    rows = df.toPandas()
    wanted = [{"a": 0.0, "b": 0.5, "c": 1.0}, {"d": 0.16, "e": 0.84}]
    # bounds as narrow as the first ones miss the rank, so that wider ones follow
    for margins in ((0.001, 1.0), (1e-9, 1e-8, 1.0)):
        found = {r.k: r for r in ranks._long_quantiles(df, ["k"], wanted, margins).collect()}
        assert set(found) == {None, 1, 2}
        for k, r in found.items():
            own = rows[rows["k"].isna() if k is None else rows["k"] == k]
            for i, names in enumerate(wanted):
                values = own[f"_v{i}"].dropna()
                for name, q in names.items():
                    assert abs(r[name] - np.quantile(values, q)) < 1e-9 if len(values) else r[name] is None


def test_zero_points_make_only_what_is_asked_for(spark, monkeypatch):
    rows = [(g, 2.0 if g % 2 else -2.0, 1.0, 2.0 if g % 2 else -2.0, *(("A", "B") if g % 2 else ("B", "A")), "A / B", 2.0) for g in range(200)]
    df = spark.createDataFrame(rows, "GROUP_ID long, DELTA_VRAD double, PAIR_ERROR double, PAIR_Z double, PROGRAM_1 string, PROGRAM_2 string, PROGRAM_PAIR string, DELTA_DAYS double")
    rules = OffsetRules(min_pairs_per_label=10, damp=0.01, balance_groups=False, center_components=False)
    whole = zero_points.zero_point_calibration(df, None, rules)
    assert set(whole) == {"summary", "by_program", "offsets"}
    made = []
    metrics = zero_points._z_metrics
    monkeypatch.setattr(zero_points, "_z_metrics", lambda scored, keys: made.append(keys) or metrics(scored, keys))
    for part, keys in (("offsets", []), ("by_program", [["run", "PROGRAM_PAIR"]]), ("summary", [["run"]])):
        made.clear()
        out = zero_points.zero_point_calibration(df, None, rules, parts=(part,))
        assert list(out) == [part] and made == keys
        assert sorted(map(str, out[part].collect())) == sorted(map(str, whole[part].collect()))


def test_groups_of_middle_size_are_sorted_as_arrays(spark, monkeypatch):
    used = []
    arrays = ranks._array_quantiles
    monkeypatch.setattr(ranks, "_array_quantiles", lambda *a: used.append(1) or arrays(*a))
    df = spark.range(12_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.randn(1).alias("a"), F.when(F.col("id") % 3 == 1, F.round(F.randn(2), 1)).alias("b"))
    df = ranks.stored(df)
    rows = df.toPandas()
    found = {r.k: r for r in ranks.column_quantiles(df, ["k"], {"a": {"low": 0.16, "top": 1.0}, "b": {"mid": 0.5}}).collect()}
    assert used and set(found) == {None, 1, 2}
    for k, r in found.items():
        own = rows[rows["k"].isna() if k is None else rows["k"] == k]
        assert abs(r.low - np.quantile(own["a"], 0.16)) < 1e-9 and r.top == own["a"].max()
        assert r.mid is None if k != 1 else abs(r.mid - np.quantile(own["b"].dropna(), 0.5)) < 1e-9


def test_shuffles_that_a_task_can_hold_arent_multiplied(spark, monkeypatch):
    from test_core import label_pairs, rows_of

    df = label_pairs(spark)
    odd = F.col("GROUP_ID") % 7
    # no stratum, no exposure, one that no program has, errors that leave pairs out
    df = df.withColumn("PROGRAM_PAIR", F.when(odd != 1, F.concat("PROGRAM_PAIR", (F.col("GROUP_ID") % 2).cast("string"))))
    df = df.withColumn("EXPOSURE_KEY_1", F.when(odd != 2, F.col("EXPOSURE_KEY_1"))).withColumn("PROGRAM_2", F.when(odd != 3, F.col("PROGRAM_2")))
    df = df.withColumn("PAIR_ERROR", F.when(odd == 4, F.lit(float("nan"))).otherwise(F.col("PAIR_ERROR"))).withColumn("DELTA_VRAD", F.when(odd == 5, F.col("DELTA_VRAD") * 40).otherwise(F.col("DELTA_VRAD")))
    df = label_offsets.stored(df)
    for rules in (OffsetRules(folds=3, min_pairs_per_label=10), OffsetRules(folds=2, min_pairs_per_label=10, clip=1.5, damp=0.01, balance_groups=False, center_components=False), OffsetRules(folds=2, min_pairs_per_label=10_000)):
        found = []
        for most in (0, 5_000_000):
            monkeypatch.setattr(label_offsets, "LOCAL_PAIRS", most)
            if most:
                # no rows of all shuffles together
                monkeypatch.setattr(label_offsets, "shuffled_pairs", None)
            out = label_offsets.permutation_control(df, 2, rules, strict=False)
            found.append((out.dtypes, rows_of(out)))
        monkeypatch.undo()
        assert found[0] == found[1] and len(found[0][1]) == 2 * rules.folds
        assert rules.min_pairs_per_label > 10 or any(r[out.columns.index("raw_width_after")] is not None for r in found[0][1])
    assert label_offsets.permutation_control(df.where("false"), 2, strict=False).count() == 0
    # a gigabyte has about 3,500,000 usable pairs
    assert label_offsets.LOCAL_PAIRS >= 4_000_000
