"""Explicit quality rules: a mask, the reasons for rejection and rollups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_label, is_finite


@dataclass(frozen=True)
class QualityRules:
    min_sn_r: float = 5.0
    require_success: bool = True
    require_rr_spectype_star: bool = True
    require_zero_rvs_warn: bool = True
    require_zero_fiberstatus: bool = True
    max_vsini: float | None = 30.0
    max_abs_vrad: float = 2000.0


def rejections(columns: list[str], rules: QualityRules = QualityRules()) -> dict[str, Column]:
    """One never-null condition for each reason that the columns allow to judge; reasons may overlap."""
    has = {c.upper() for c in columns}
    no = F.lit(False)
    v, e = F.col("VRAD"), F.col("VRAD_ERR")
    out = {"NONFINITE_RV": ~is_finite(v), "INVALID_RV_ERROR": ~is_finite(e) | F.coalesce(e <= 0, no), "EXTREME_ABS_RV": F.coalesce((F.abs(v) > rules.max_abs_vrad) & ~F.isnan(v), no)}
    if "SN_R" in has:
        out["LOW_SN_R"] = ~is_finite(F.col("SN_R")) | F.coalesce(F.col("SN_R") < rules.min_sn_r, no)
    if rules.require_success and "SUCCESS" in has:
        out["FIT_NOT_SUCCESSFUL"] = ~F.coalesce(F.col("SUCCESS"), no)
    if rules.require_rr_spectype_star and "RR_SPECTYPE" in has:
        out["NON_STELLAR_RR_SPECTYPE"] = ~F.coalesce(clean_label(F.col("RR_SPECTYPE")) == "STAR", no)
    if rules.require_zero_rvs_warn and "RVS_WARN" in has:
        out["RVS_WARNING"] = ~F.coalesce(F.col("RVS_WARN") == 0, no)
    if rules.require_zero_fiberstatus and "FIBERSTATUS" in has:
        out["FIBER_WARNING"] = ~F.coalesce(F.col("FIBERSTATUS").try_cast("double") == 0, no)
    if rules.max_vsini is not None and "VSINI" in has:
        out["MISSING_VSINI"] = ~is_finite(F.col("VSINI"))
        out["HIGH_VSINI"] = is_finite(F.col("VSINI")) & F.coalesce(F.col("VSINI") >= rules.max_vsini, no)
    return out


def is_good(columns: list[str], rules: QualityRules = QualityRules()) -> Column:
    """True where no rule rejects; judged on raw velocities, not adopted ones."""
    return ~reduce(lambda a, b: a | b, rejections(columns, rules).values())


def with_quality(epochs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    return epochs.withColumn("IS_GOOD", is_good(epochs.columns, rules))


def rejection_counts(epochs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(REASON, N_REJECTED, FRACTION) in one pass; fractions of an empty table are 0."""
    reasons = rejections(epochs.columns, rules)
    counts = epochs.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(name) for name, c in reasons.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("REASON"), F.col(name).alias("N_REJECTED")) for name in reasons]))
    return counts.select("_n", rows.alias("r")).select("r.*", (F.col("r.N_REJECTED") / F.greatest("_n", F.lit(1))).alias("FRACTION"))


def epoch_quality(epochs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Raw and good epochs, targets and groups by SURVEY and PROGRAM, or of ALL without either.

    Counted first by (keys, group, target), so that distinct counts are counts of groups; null keys are a group.
    """
    keys = [c for c in ("SURVEY", "PROGRAM") if c in epochs.columns]
    rows = with_quality(epochs, rules)
    if not keys:
        keys, rows = ["SURVEY"], rows.withColumn("SURVEY", F.lit("ALL"))
    good = F.col("IS_GOOD")
    cells = rows.groupBy(*keys, "GROUP_ID", "TARGETID").agg(F.count("*").alias("n"), F.count_if(good).alias("g"))
    by_target = cells.groupBy(*keys, "TARGETID").agg(F.sum("g").alias("g"))
    targets = by_target.groupBy(*keys).agg(F.count("TARGETID").alias("N_TARGETIDS_RAW"), F.count(F.when(F.col("g") > 0, F.col("TARGETID"))).alias("N_TARGETIDS_GOOD"))
    by_group = cells.groupBy(*keys, "GROUP_ID").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    groups = by_group.groupBy(*keys).agg(
        F.sum("n").alias("N_EPOCHS_RAW"), F.count("GROUP_ID").alias("N_GROUPS_RAW"), F.sum("g").alias("N_EPOCHS_GOOD"),
        F.count(F.when(F.col("g") > 0, F.col("GROUP_ID"))).alias("N_GROUPS_GOOD"), F.count(F.when(F.col("g") > 1, F.col("GROUP_ID"))).alias("N_GROUPS_2PLUS_GOOD_EPOCHS"),
    )
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = groups.alias("a").join(targets.alias("b"), same)
    columns = ["N_EPOCHS_RAW", "N_TARGETIDS_RAW", "N_GROUPS_RAW", "N_EPOCHS_GOOD", "N_TARGETIDS_GOOD", "N_GROUPS_GOOD", "N_GROUPS_2PLUS_GOOD_EPOCHS"]
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], *columns, (F.col("N_EPOCHS_GOOD") / F.col("N_EPOCHS_RAW")).alias("GOOD_EPOCH_FRACTION"))
