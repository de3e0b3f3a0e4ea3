"""One row for each source: counts, robust statistics and a test against constancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remeasure.functions.chi2 import chi2_log_sf
from remeasure.functions.columns import is_finite
from remeasure.functions.ranks import grouped_quantiles, same
from remeasure.session import stored

MAD_TO_SIGMA = 1.4826
# The columns of the summary.
SUMMARY_COLUMNS = [
    "group_id", "group_kind", "source_id", "targetid", "n_epochs_raw", "n_epochs_good", "weighted_mean_vrad", "median_vrad", "robust_scatter",
    "chi2_const", "dof", "p_const", "log_p_const", "max_pair_sigma", "time_baseline_days", "classification", "evidence_score",
]


def value_column(df: DataFrame) -> str:
    """The adopted velocity where there is one."""
    return "VRAD_ADOPTED" if "VRAD_ADOPTED" in df.columns else "VRAD"


def error_column(df: DataFrame) -> str:
    return "VRAD_ERR_ADOPTED" if "VRAD_ERR_ADOPTED" in df.columns else "VRAD_ERR"


#: Rows of a part in which a first frontier is found.
FRONTIER_PART = 1_000_000


def max_pair_sigma(good: DataFrame, key: str, value: str, error: str) -> DataFrame:
    """(key, max_pair_sigma): the largest |v1 - v2| / hypot(e1, e2) of any two epochs of a group; null for a single one.

    Of all pairs only those with a group's highest or lowest value are formed, once for each row;
    the best of them is a bound. An epoch stays if the group's other end at the group's smallest
    error could beat the bound, and if none beats it in both value and error. These few are kept as
    rows and meet in a join. Running maxima are taken in parts of about FRONTIER_PART rows first.
    """
    v, e = F.col("v"), F.col("e")
    rows = good.select(key, F.col(value).cast("double").alias("v"), F.col(error).cast("double").alias("e")).where(is_finite(v) & is_finite(e) & (e > 0))
    parts = max(1, -(-rows.count() // FRONTIER_PART))
    ends = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("e").alias("least"), F.max("v").alias("top"), F.max_by("e", "v").alias("top_e"), F.min("v").alias("low"), F.min_by("e", "v").alias("low_e"))
    placed = rows.alias("r").join(ends.alias("g"), same("r", "g", [key])).select("r.*", "g.top", "g.top_e", "g.low", "g.low_e", "g.least")
    up, down = v - F.col("low"), F.col("top") - v
    tried = placed.select("*", F.greatest(up / F.hypot(e, F.col("low_e")), down / F.hypot(e, F.col("top_e"))).alias("tried"), (up / F.hypot(e, F.col("least"))).alias("up"), (down / F.hypot(e, F.col("least"))).alias("down"))
    bound = tried.groupBy(key).agg(F.max("tried").alias("bound"))
    near = tried.alias("r").join(bound.alias("b"), same("r", "b", [key])).where("greatest(r.up, r.down) >= b.bound * (1 - 1e-12)")
    near = stored(near.select(f"r.{key}", "r.v", "r.e", (F.col("r.up") >= F.col("b.bound") * (1 - 1e-12)).alias("is_high"), (F.col("r.down") >= F.col("b.bound") * (1 - 1e-12)).alias("is_low")))

    def frontier(df: DataFrame, by: list[str], sign: int) -> DataFrame:
        earlier = Window.partitionBy(key, *by).orderBy("e", (v * -sign)).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_best", F.max(v * sign).over(earlier)).where((F.col("_best").isNull()) | (v * sign > F.col("_best"))).drop("_best")

    def side(flag: str, sign: int) -> DataFrame:
        few = near.where(flag)
        if parts > 1:
            few = frontier(few.withColumn("_part", F.pmod(F.xxhash64("v", "e"), F.lit(parts))), ["_part"], sign).drop("_part")
        return frontier(few, [], sign).select(key, "v", "e")

    pairs = side("is_high", 1).alias("h").join(side("is_low", -1).alias("l"), same("h", "l", [key]))
    sigma = pairs.groupBy(F.col(f"h.{key}").alias(key)).agg(F.max((F.col("h.v") - F.col("l.v")) / F.hypot("h.e", "l.e")).alias("sigma"))
    both = ends.alias("g").join(sigma.alias("s"), same("g", "s", [key]), "left")
    return both.select(f"g.{key}", F.when(F.col("g.n") > 1, F.coalesce("s.sigma", F.lit(0.0))).alias("max_pair_sigma"))


def classify(n_good: Column, log_p: Column, sigma: Column, p_threshold: float = 1e-6, sigma_threshold: float = 5.0) -> Column:
    """quality_limited without good epochs, insufficient_epochs with one, else candidate_variable or stable_like."""
    varies = F.coalesce((log_p < F.log(F.lit(p_threshold))) & (sigma >= sigma_threshold), F.lit(False))
    return F.when(n_good == 0, "quality_limited").when(n_good < 2, "insufficient_epochs").when(varies, "candidate_variable").otherwise("stable_like")


def summarize_sources(epochs: DataFrame, p_threshold: float = 1e-6, sigma_threshold: float = 5.0) -> DataFrame:
    """The columns SUMMARY_COLUMNS for every group of ``epochs`` (with IS_GOOD).

    Groups are GROUP_ID, else TARGETID. Metadata are the first non-null ones by time and exposure.
    Statistics use good epochs and adopted values where there are some; without good epochs they
    are null. p_const may underflow to 0, log_p_const and the evidence (capped at 300) don't.
    """
    key = "GROUP_ID" if "GROUP_ID" in epochs.columns else "TARGETID"
    has = {c.upper() for c in epochs.columns}
    meta = [c for c in dict.fromkeys([key, "GROUP_KIND", "SOURCE_ID", "TARGETID", "MJD", "EXPID"]) if c in has]
    rows = stored(epochs.select(*meta, "IS_GOOD", F.col(value_column(epochs)).cast("double").alias("v"), F.col(error_column(epochs)).cast("double").alias("e")))
    no = F.lit(None)
    order = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) for c in ("MJD", "EXPID") if c in has], "TARGETID")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)) if c in has else no
    mjd = F.when(F.col("IS_GOOD"), F.col("MJD")) if "MJD" in has else no.cast("double")
    base = rows.groupBy(key).agg(
        first("GROUP_KIND").cast("string").alias("group_kind"), first("SOURCE_ID").cast("bigint").alias("source_id"), first("TARGETID").alias("first_target"),
        F.count("*").alias("n_epochs_raw"), F.count_if("IS_GOOD").alias("n_epochs_good"), (F.max(mjd) - F.min(mjd)).alias("time_baseline_days"),
    )
    chosen = rows.where("IS_GOOD").select(key, "v", "e")
    medians = grouped_quantiles(chosen, [key], "v", {"median_vrad": 0.5}, kept=True)
    # sums are taken about the median, so that large velocities don't cancel
    away = stored(chosen.alias("c").join(medians.alias("m"), same("c", "m", [key])).select("c.*", "m.median_vrad", (F.col("c.v") - F.col("m.median_vrad")).alias("x")).withColumn("d", F.abs("x")))
    w, x = 1 / (F.col("e") * F.col("e")), F.col("x")
    sums = away.groupBy(key).agg(F.first("median_vrad").alias("median_vrad"), F.sum(w).alias("s0"), F.sum(w * x).alias("s1"), F.sum(w * x * x).alias("s2"))
    scatter = grouped_quantiles(away, [key], "d", {"mad": 0.5}, kept=True)
    joined = base
    for part in (sums, scatter, max_pair_sigma(chosen, key, "v", "e")):
        own = [c for c in part.columns if c != key]
        joined = joined.alias("a").join(part.alias("b"), same("a", "b", [key]), "left").select("a.*", *[f"b.{c}" for c in own])
    mean = F.col("median_vrad") + F.col("s1") / F.col("s0")
    dof = F.greatest(F.col("n_epochs_good") - 1, F.lit(0)).cast("int")
    chi2 = F.when(F.col("n_epochs_good") > 0, F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("s0"), F.lit(0.0)))
    tested = joined.withColumns({"weighted_mean_vrad": mean, "dof": dof, "chi2_const": chi2})
    tested = tested.withColumn("log_p_const", F.when(F.col("dof") > 0, chi2_log_sf(F.coalesce("chi2_const", F.lit(0.0)), F.col("dof"))))
    final = {
        "p_const": F.exp("log_p_const"),
        "robust_scatter": MAD_TO_SIGMA * F.col("mad"),
        "classification": classify(F.col("n_epochs_good"), F.col("log_p_const"), F.col("max_pair_sigma"), p_threshold, sigma_threshold),
        "evidence_score": F.coalesce(F.least(F.lit(300.0), -F.col("log_p_const") / F.log(F.lit(10.0))), F.lit(0.0)),
    }
    named = tested.withColumns(final).withColumnRenamed(key, "group_id").withColumnRenamed("first_target", "targetid")
    return named.select(*SUMMARY_COLUMNS)


def ranked(summary: DataFrame) -> DataFrame:
    """By class, then falling evidence and pair sigma; ties by group_id."""
    return summary.orderBy("classification", F.desc_nulls_last("evidence_score"), F.desc_nulls_last("max_pair_sigma"), "group_id")


def candidates(summary: DataFrame, strict: bool = False) -> DataFrame:
    """Candidate variables; strict ones have at least 3 good epochs over more than a day."""
    rows = summary.where("classification = 'candidate_variable'")
    return rows.where("n_epochs_good >= 3 and time_baseline_days > 1") if strict else rows


def classification_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("classification").agg(F.count("*").alias("n_sources"))
