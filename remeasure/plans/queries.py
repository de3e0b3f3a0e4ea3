"""The registered queries of the core library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_label as _clean_label
from remeasure.functions.columns import clean_night as _clean_night
from remeasure.functions.columns import clean_pair_label as _clean_pair_label
from remeasure.operators import calibration, correction, label_offsets, pairs, quality, references, schema, spikes, summary, zero_points
from remeasure.operators.label_offsets import OffsetRules
from remeasure.session import stored, table

Query = Callable[[SparkSession, str], DataFrame]


def _on(names: str, f: Callable[..., DataFrame]) -> Query:
    """A query that calls ``f`` with the tables ``names``."""
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names.split()])


#: Labels need this many pairs on the test tables, which are small for the default.
LEAST_PAIRS = 10
TEST_RULES = OffsetRules(min_pairs_per_label=LEAST_PAIRS)
ZERO_RULES = OffsetRules(min_pairs_per_label=LEAST_PAIRS, damp=0.05, balance_groups=False, center_components=False)
#: Shares of pairs that a sweep over caps compares.
CAPS = (10, 20, 50)


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of rvtab as epochs, each once, as first delivered."""
    rows = table(spark, sf_dir, "rvtab").where("obs_id is not null")
    columns = ["ingested_at", *[c for c in rows.columns if c not in ("obs_id", "ingested_at")]]
    first = rows.groupBy("obs_id").agg(F.min(F.struct(*columns)).alias("f")).select("obs_id", "f.*")
    return schema.as_epochs(first.drop("group_id", "ingested_at"))


def _clean_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({c: _clean_label(F.col(c)) for c in ("SURVEY", "PROGRAM")})


def adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs with the offsets of the correction table on which its rows agree, and a quality mask."""
    offsets = correction.agreeing_correction(correction.clean_correction(table(spark, sf_dir, "backup_correction")))
    return quality.with_quality(correction.apply_velocity_calibration(epochs(spark, sf_dir), offsets))


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.epoch_pairs(adopted(spark, sf_dir))


def delivered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs table, each pair once (of rows that differ the smallest), with clean labels; written once."""
    rows = table(spark, sf_dir, "pairs").where("pair_id is not null")
    others = [
        "group_id", "group_kind", "delta_days", "delta_vrad", "pair_error", "pair_error_formal", "program_1", "program_2",
        "program_pair", "night_1", "night_2", "exposure_key_1", "exposure_key_2",
    ]
    rows = rows.groupBy("pair_id").agg(F.min(F.struct(*others)).alias("f")).select("pair_id", "f.*")
    rows = rows.toDF(*[c.upper() for c in rows.columns])
    cleaned = {f"PROGRAM_{k}": _clean_label(F.col(f"PROGRAM_{k}")) for k in (1, 2)} | {f"NIGHT_{k}": _clean_night(F.col(f"NIGHT_{k}")) for k in (1, 2)}
    return stored(rows.withColumns({**cleaned, "PROGRAM_PAIR": _clean_pair_label(F.col("PROGRAM_PAIR"))}))


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles to a number of digits that doesn't depend on the order of sums."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_offsets.prepare(delivered_pairs(spark, sf_dir), TEST_RULES)


#: Widths of differences, which have four digits, are exact with seven; rounding to fewer could meet a tie.
_EXACT = ("raw_width_before", "median_before")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 7 if c in _EXACT else 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _experiment(part: str) -> Query:
    return lambda spark, sf_dir: _shown(label_offsets.run_folds(_prepared(spark, sf_dir), TEST_RULES)[part].drop("run"))


def _whole_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of the experiment, with what all of them share, in one table."""
    out = label_offsets.run_experiment(delivered_pairs(spark, sf_dir), TEST_RULES, permutations=0)
    summary = out["summary"].select("fold", "n_label_pairs", "n_gaia_group_pairs", "gaia_group_pair_fraction", "n_train_pairs", "raw_width_before", "raw_width_after")
    half = out["reproducibility"].select(F.col("n_labels").alias("n_common_labels"), F.lit(True).alias("k"))
    return _shown(summary.withColumn("k", F.lit(True)).join(half, "k", "left").drop("k"))


def _zero_points(part: str) -> Query:
    return lambda spark, sf_dir: _rounded(zero_points.zero_point_calibration(pair_table(spark, sf_dir), None, ZERO_RULES, parts=(part,))[part], 4)


def _cap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and residual widths by the cap on pairs of a group: how much the cap leaves out."""
    judged = stored(adopted(spark, sf_dir).where("IS_GOOD"))
    found = [calibration.headline(pairs.epoch_pairs(judged, cap)).select(F.lit(cap).alias("CAP"), "*") for cap in CAPS]
    return _rounded(reduce(DataFrame.unionByName, found))


def _label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_offsets.with_use(_prepared(spark, sf_dir), 5, "own")


def _by_model(df: DataFrame, column: str) -> DataFrame:
    """One row for each place of an array with a value for each model."""
    return df.select("*", F.posexplode(column).alias("model", "_x")).drop(column, "run").withColumnRenamed("_x", column)


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _label_pairs(spark, sf_dir).withColumn("change", F.array(*[F.lit(0.0)] * 5))
    return _rounded(label_offsets.pair_floors(stored(rows), 5, TEST_RULES).drop("run").withColumnRenamed("m", "model"))


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets and catalogue velocities taken as one correction: keys on which the two disagree."""
    catalogue = table(spark, sf_dir, "gaia").select("targetid", F.col("radial_velocity").alias("vrad_offset"))
    both = table(spark, sf_dir, "backup_correction").select("targetid", "vrad_offset").unionByName(catalogue)
    return correction.correction_conflicts(correction.clean_correction(both))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = summary.summarize_sources(adopted(spark, sf_dir))
    digits = {"chi2_const": 4, "log_p_const": 4, "evidence_score": 4}
    return df.select(*[F.round(c, digits.get(c, 6)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _on_pairs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _rounded(f(stored(pair_table(spark, sf_dir))))


def _calibration(group: str | None, z: str, later: bool = False) -> Query:
    return _on_pairs(lambda df: calibration.summarize_pair_residuals(calibration.interday(df) if later else df, group, z))


QUERIES: dict[str, Query] = {
    "p1_found": _on("rvtab pairs", spikes.cases),
    "p1_flags": _on("rvtab pairs", spikes.flag_readings),
    "p4_found": _on("rvtab gaia backup_correction", references.orphans),
    "p4_by_night": _on("rvtab gaia backup_correction", references.orphans_by_night),
    "p4_by_tile": _on("rvtab gaia backup_correction correction_summary", references.coverage_by_tile),
    "epochs": lambda spark, d: epochs(spark, d).select("OBS_ID", "TARGETID", "SOURCE_ID", "GROUP_ID", "GROUP_KIND", "MJD", "VRAD", "VRAD_ERR"),
    "adopted_velocity": lambda spark, d: _rounded(adopted(spark, d).select("OBS_ID", "VRAD_OFFSET", "VRAD_FLOOR", "VRAD_ADOPTED", "VRAD_ERR_ADOPTED")),
    "correction_coverage": lambda spark, d: correction.correction_coverage(adopted(spark, d)),
    "correction_conflicts": lambda spark, d: correction.correction_conflicts(correction.clean_correction(table(spark, d, "backup_correction"))),
    "quality_filtered": lambda spark, d: adopted(spark, d).where("IS_GOOD").select("OBS_ID"),
    "rejection_counts": lambda spark, d: _rounded(quality.rejection_counts(epochs(spark, d))),
    "epoch_quality": lambda spark, d: _rounded(quality.epoch_quality(_clean_keys(epochs(spark, d)))),
    "reference_velocity_conflicts": _conflicts,
    "source_summary": _summary,
    "source_p_values": lambda spark, d: _summary(spark, d).select("group_id", "dof", "chi2_const", "p_const", "log_p_const", "evidence_score"),
    "classification_counts": lambda spark, d: summary.classification_counts(summary.summarize_sources(adopted(spark, d))),
    "strict_candidates": lambda spark, d: summary.candidates(_summary(spark, d), strict=True),
    "top_candidates": lambda spark, d: summary.ranked(summary.candidates(_summary(spark, d))).limit(10),
    "pair_table": lambda spark, d: _rounded(pair_table(spark, d), 4),
    "calibration_overall": _calibration(None, "PAIR_Z"),
    "calibration_overall_formal": _calibration(None, "PAIR_Z_FORMAL"),
    "calibration_by_program": _calibration("PROGRAM_PAIR", "PROGRAM_PAIR_Z"),
    "calibration_by_program_formal": _calibration("PROGRAM_PAIR", "PROGRAM_PAIR_Z_FORMAL"),
    "calibration_interday": _calibration("PROGRAM_PAIR", "PROGRAM_PAIR_Z", True),
    "calibration_interday_formal": _calibration("PROGRAM_PAIR", "PROGRAM_PAIR_Z_FORMAL", True),
    "calibration_by_sn": _on_pairs(lambda df: calibration.summarize_pair_residuals(calibration.add_quantile_bin(df, "SN_R_MIN"), "SN_R_MIN_BIN")),
    "residual_histogram": _on_pairs(calibration.residual_histogram),
    "program_pair_counts": _on_pairs(calibration.program_pair_counts),
    "report_headline": _on_pairs(calibration.headline),
    "calibration_tables": _on_pairs(calibration.all_tables),
    "pair_cap_sweep": _cap_sweep,
    "label_pairs": lambda spark, d: _rounded(_label_pairs(spark, d).drop("run", "use").withColumnRenamed("fold", "model")),
    "label_endpoint_counts": lambda spark, d: _by_model(label_offsets.endpoint_counts(_label_pairs(spark, d), 5), "n").where("n > 0"),
    "kept_label_pairs": lambda spark, d: _rounded(_by_model(label_offsets.kept_pairs(_label_pairs(spark, d), 5, TEST_RULES).drop("fold"), "use").where("use").drop("use")),
    "label_pair_sums": lambda spark, d: _rounded(label_offsets.pair_sums(_label_pairs(spark, d).withColumn("kept", F.col("use")), 5).drop("run").withColumnRenamed("m", "model")),
    "robust_metrics": lambda spark, d: _rounded(label_offsets.robust_metrics(_prepared(spark, d), ["PROGRAM_PAIR"], {"": F.col("d")}, F.col("formal") ** 2)),
    "pair_floors": _floors,
    "exposure_conflicts": lambda spark, d: label_offsets.exposure_conflicts(delivered_pairs(spark, d)),
    "exposure_nights": lambda spark, d: label_offsets.exposure_nights(delivered_pairs(spark, d), list(range(label_offsets.DEFAULT_PERMUTATIONS))),
    "fold_summary": _experiment("summary"),
    "fold_by_program": _experiment("by_program"),
    "fold_offsets": _experiment("offsets"),
    "label_experiment": _whole_experiment,
    "half_reproducibility": lambda spark, d: _rounded(label_offsets.half_reproducibility(_prepared(spark, d), TEST_RULES), 4),
    # nights of the delivered pairs are in conflict: the smallest counts
    "permutation_control": lambda spark, d: _shown(label_offsets.permutation_control(delivered_pairs(spark, d), rules=TEST_RULES, strict=False)),
    "zero_point_summary": _zero_points("summary"),
    "zero_point_by_program": _zero_points("by_program"),
    "zero_point_offsets": _zero_points("offsets"),
}

_READINGS = r"""
WITH obs AS (
  SELECT obs_id, min(targetid) AS source, min(mjd) AS mjd, min(vrad) AS vrad, min(vrad_err) AS vrad_err
  FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY ingested_at) AS k FROM rvtab) WHERE k = 1 GROUP BY obs_id
), zs AS (
  SELECT pair_id, min(group_id) AS source, min(pair_z) AS z FROM (SELECT DISTINCT pair_id, group_id, pair_z FROM pairs) GROUP BY pair_id
), readings AS (
  SELECT 'rvtab' AS rec_table, 'vrad' AS field_name, source, mjd AS t, obs_id AS rec_id, vrad AS v FROM obs
  UNION ALL SELECT 'rvtab', 'vrad_err', source, mjd, obs_id, vrad_err FROM obs
  UNION ALL SELECT 'pairs', 'pair_z', source, 0, pair_id, z FROM zs
), r AS (SELECT * FROM readings WHERE v IS NOT NULL AND NOT isnan(v)),
normal AS (
  SELECT field_name, source, count(*) AS n, quantile_cont(v, 0.5) AS med, (quantile_cont(v, 0.84) - quantile_cont(v, 0.16)) / 2 AS spread
  FROM r WHERE isfinite(v) AND source IS NOT NULL GROUP BY field_name, source
), turns AS (
  SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS turn FROM r WHERE source IS NOT NULL
  WINDOW w AS (PARTITION BY field_name, source ORDER BY t, rec_id)
), runs AS (SELECT *, sum(turn) OVER (PARTITION BY field_name, source ORDER BY t, rec_id) AS run FROM turns),
lengths AS (SELECT *, count(*) OVER (PARTITION BY field_name, source, run) AS length FROM runs)
SELECT rec_table, field_name, rec_id FROM r
WHERE isinf(v) OR (field_name = 'vrad' AND abs(v) > 2000) OR (field_name = 'vrad_err' AND v <= 0)
UNION SELECT rec_table, field_name, rec_id FROM lengths WHERE length >= 4
UNION SELECT r.rec_table, r.field_name, r.rec_id FROM r JOIN normal USING (field_name, source)
WHERE isfinite(v) AND n >= 8 AND abs(v - med) > 10 * spread
"""

_REFERENCES = r"""
WITH obs AS (
  SELECT obs_id, targetid, ingested_at, night, tileid,
    coalesce(upper(regexp_replace(survey, '^\s+|\s+$', '', 'g')) = 'MAIN' AND upper(regexp_replace(program, '^\s+|\s+$', '', 'g')) = 'BACKUP', false) AS is_main_backup
  FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY ingested_at) AS k FROM rvtab) WHERE k = 1
), refs AS (
  SELECT 'gaia' AS ref_table, * FROM obs WHERE targetid IS NOT NULL
  UNION ALL SELECT 'backup_correction', * FROM obs WHERE targetid IS NOT NULL AND is_main_backup
), parents AS (
  SELECT 'gaia' AS ref_table, targetid, loaded_at, deleted_at FROM gaia
  UNION ALL SELECT 'backup_correction', targetid, loaded_at, deleted_at FROM backup_correction
), valid AS (
  SELECT DISTINCT ref_table, obs_id FROM refs JOIN parents p USING (ref_table, targetid)
  WHERE loaded_at <= ingested_at AND (deleted_at IS NULL OR ingested_at < deleted_at)
), judged AS (
  SELECT r.*, v.obs_id IS NOT NULL AS in_force, (ref_table, targetid) IN (SELECT (ref_table, targetid) FROM parents WHERE targetid IS NOT NULL) AS known
  FROM refs r LEFT JOIN valid v USING (ref_table, obs_id)
)
"""


_EPOCHS = r"""
WITH first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY ingested_at) AS k FROM rvtab WHERE obs_id IS NOT NULL) WHERE k = 1),
epochs AS (
  SELECT obs_id, targetid, source_id, expid, fiber, tileid, night, mjd, survey, program, CASE WHEN NOT isnan(vrad) THEN vrad END AS vrad, vrad_err, sn_r,
    rvs_warn, coalesce(success, false) AS success, vsini, rr_spectype,
    CASE WHEN source_id > 0 THEN source_id ELSE -coalesce(targetid, 0) END AS group_id,
    CASE WHEN source_id > 0 THEN 'GAIA_SOURCE_ID' ELSE 'TARGETID_FALLBACK' END AS group_kind,
    coalesce(upper(regexp_replace(survey, '^\s+|\s+$', '', 'g')), '') AS cs, coalesce(upper(regexp_replace(program, '^\s+|\s+$', '', 'g')), '') AS cp
  FROM first
), offsets AS (
  SELECT targetid, min(vrad_offset) AS vrad_offset FROM backup_correction WHERE targetid IS NOT NULL AND isfinite(vrad_offset)
  GROUP BY targetid HAVING min(vrad_offset) = max(vrad_offset)
), adopted AS (
  SELECT e.*, cs = 'MAIN' AND cp = 'BACKUP' AS backup, o.targetid IS NOT NULL AS matched,
    CASE WHEN cs = 'MAIN' AND cp = 'BACKUP' THEN coalesce(o.vrad_offset, 0.0) ELSE 0.0 END AS vrad_offset,
    CASE cp WHEN 'BRIGHT' THEN 1.0 WHEN 'BACKUP' THEN 2.0 WHEN 'DARK' THEN 1.6 ELSE 0.0 END::DOUBLE AS vrad_floor,
    NOT coalesce(isfinite(vrad), false) AS r1, NOT coalesce(isfinite(vrad_err), false) OR coalesce(vrad_err <= 0, false) AS r2, coalesce(abs(vrad) > 2000, false) AS r3,
    NOT coalesce(isfinite(sn_r), false) OR coalesce(sn_r < 5, false) AS r4, NOT success AS r5,
    NOT coalesce(upper(regexp_replace(rr_spectype, '^\s+|\s+$', '', 'g')) = 'STAR', false) AS r6, NOT coalesce(rvs_warn = 0, false) AS r7,
    NOT coalesce(isfinite(vsini), false) AS r8, coalesce(isfinite(vsini) AND vsini >= 30, false) AS r9
  FROM epochs e LEFT JOIN offsets o USING (targetid)
), judged AS (
  SELECT *, vrad - vrad_offset AS v, sqrt(vrad_err * vrad_err + vrad_floor * vrad_floor) AS e, NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9) AS good FROM adopted
)
"""

#: ln of the upper tail of chi-square for whole degrees of freedom: a finite sum, for odd ones with the scaled complementary error function.
_LOG_P = """CASE WHEN dof = 0 THEN NULL WHEN chi2 <= 0 THEN 0.0 ELSE -chi2 / 2 + top + ln(list_sum(list_transform(terms, lambda t: exp(t - top)))) END"""
_TERMS = """CASE WHEN dof = 0 OR chi2 <= 0 THEN NULL WHEN dof % 2 = 0 THEN list_transform(range(0, dof // 2), lambda i: i * ln(chi2 / 2) - lgamma(i + 1.0))
  ELSE list_concat([ln(erfcx)], list_transform(range(1, (dof - 1) // 2 + 1), lambda i: (i - 0.5) * ln(chi2 / 2) - lgamma(i + 0.5))) END"""
_ERFCX = """CASE WHEN dof = 0 OR chi2 <= 0 THEN NULL WHEN chi2 < 8 THEN exp(chi2 / 2) - list_sum(list_transform(range(0, 80), lambda n: exp((n + 0.5) * ln(chi2 / 2) - lgamma(n + 1.5))))
  ELSE 1 / (sqrt(pi()) * list_reduce(range(200, 0, -1), lambda a, i: sqrt(chi2 / 2) + i / 2.0 / a, sqrt(chi2 / 2))) END"""

_SOURCES = (
    _EPOCHS
    + """, g AS (
  SELECT group_id, v, e, mjd, median(v) OVER (PARTITION BY group_id) AS med FROM judged WHERE good
), sigma AS (
  SELECT a.group_id, max(abs(a.v - b.v) / sqrt(a.e * a.e + b.e * b.e)) AS max_pair_sigma FROM g a JOIN g b ON a.group_id = b.group_id AND a.v > b.v GROUP BY a.group_id
), good AS (
  SELECT group_id, count(*) AS n, sum(v / (e * e)) / sum(1 / (e * e)) AS mean, sum(1 / (e * e)) AS sw, median(v) AS med,
    1.4826 * quantile_cont(abs(v - med), 0.5) AS mad, max(mjd) - min(mjd) AS baseline FROM g GROUP BY group_id
), chi AS (SELECT group_id, sum(((v - mean) / e) * ((v - mean) / e)) AS chi2 FROM g JOIN good USING (group_id) GROUP BY group_id),
raw AS (
  SELECT group_id, min(group_kind) AS group_kind, min(source_id) AS source_id, count(*) AS n_raw,
    arg_min(targetid, (coalesce(mjd, 'inf'::DOUBLE), coalesce(expid, 'inf'::DOUBLE), targetid)) FILTER (WHERE targetid IS NOT NULL) AS targetid
  FROM judged GROUP BY group_id
), tested AS (
  SELECT raw.*, coalesce(n, 0) AS n_good, mean, good.med, mad, chi2, greatest(coalesce(n, 0) - 1, 0)::INT AS dof,
    CASE WHEN n > 1 THEN coalesce(max_pair_sigma, 0) END AS sigma, baseline
  FROM raw LEFT JOIN good USING (group_id) LEFT JOIN chi USING (group_id) LEFT JOIN sigma USING (group_id)
), scaled AS (SELECT *, """
    + _ERFCX
    + """ AS erfcx FROM tested), listed AS (SELECT *, """
    + _TERMS
    + """ AS terms FROM scaled), topped AS (SELECT *, list_max(terms) AS top FROM listed), judged_p AS (SELECT *, """
    + _LOG_P
    + """ AS log_p FROM topped),
classed AS (
  SELECT *, exp(log_p) AS p_const, CASE WHEN n_good = 0 THEN 'quality_limited' WHEN n_good < 2 THEN 'insufficient_epochs'
    WHEN sigma >= 5 AND log_p < ln(1e-6) THEN 'candidate_variable' ELSE 'stable_like' END AS classification,
    coalesce(least(300.0, -log_p / ln(10.0)), 0.0) AS evidence
  FROM judged_p
), summed AS (
  SELECT group_id, group_kind, source_id, targetid, n_raw AS n_epochs_raw, n_good AS n_epochs_good, round(mean, 6) AS weighted_mean_vrad, round(med, 6) AS median_vrad, round(mad, 6) AS robust_scatter,
    round(chi2, 4) AS chi2_const, dof, round(p_const, 6) AS p_const, round(log_p, 4) AS log_p_const, round(sigma, 6) AS max_pair_sigma, round(baseline, 6) AS time_baseline_days, classification, round(evidence, 4) AS evidence_score
  FROM classed
)
"""
)

_PAIRS = (
    _EPOCHS
    + r""", plain AS (
  SELECT *, CASE WHEN cs IN ('', 'NAN') THEN 'UNKNOWN' ELSE cs END AS s, CASE WHEN cp IN ('', 'NAN') THEN 'UNKNOWN' ELSE cp END AS p,
    coalesce(CAST(expid AS VARCHAR), '0') AS xs, coalesce(CAST(fiber AS VARCHAR), '0') AS fs, coalesce(CAST(targetid AS VARCHAR), '0') AS ts
  FROM judged WHERE good
), ranked AS (
  SELECT *, s || '|' || p || '|' || xs || '|' || fs || '|' || ts AS obs_key, s || '|' || p || '|' || xs AS exposure_key,
    count(*) OVER (PARTITION BY group_id) AS n,
    row_number() OVER (PARTITION BY group_id ORDER BY mjd NULLS LAST, expid NULLS LAST, s || '|' || p || '|' || xs || '|' || fs || '|' || ts, vrad, vrad_err, v) - 1 AS k
  FROM plain
), sizes AS (SELECT DISTINCT group_id, n, n * (n - 1) // 2 AS np FROM ranked WHERE n > 1),
chosen AS (
  SELECT group_id, CASE WHEN np <= 50 THEN i WHEN i = 49 THEN np - 1 ELSE floor(i * ((np - 1)::DOUBLE / 49.0))::BIGINT END AS pos
  FROM sizes CROSS JOIN range(50) t(i) WHERE np > 50 OR i < np
), combos AS (
  SELECT a.group_id, a.n, a.k AS i, b.k AS j, a.k * (2 * a.n - a.k - 1) // 2 + b.k - a.k - 1 AS pos, a AS x, b AS y
  FROM ranked a JOIN ranked b ON a.group_id = b.group_id AND a.k < b.k
), made AS (
  SELECT x, y, x.v - y.v AS d, sqrt(x.e * x.e + y.e * y.e) AS err, x.vrad - y.vrad AS df, sqrt(x.vrad_err * x.vrad_err + y.vrad_err * y.vrad_err) AS ef,
    CASE WHEN x.p <= y.p THEN 1.0 ELSE -1.0 END AS turn FROM combos JOIN chosen USING (group_id, pos)
), pairs_made AS (
  SELECT x.group_id AS group_id, x.group_kind AS group_kind, x.targetid AS targetid_1, y.targetid AS targetid_2,
    CASE WHEN x.source_id > 0 THEN x.source_id END AS source_id_1, CASE WHEN y.source_id > 0 THEN y.source_id END AS source_id_2,
    x.obs_key AS obs_key_1, y.obs_key AS obs_key_2, x.exposure_key AS exposure_key_1, y.exposure_key AS exposure_key_2, x.expid AS expid_1, y.expid AS expid_2,
    x.mjd AS mjd_1, y.mjd AS mjd_2, y.mjd - x.mjd AS delta_days, x.v AS vrad_1, y.v AS vrad_2, d AS delta_vrad, err AS pair_error, d / err AS pair_z,
    x.vrad AS vrad_formal_1, y.vrad AS vrad_formal_2, df AS delta_vrad_formal, ef AS pair_error_formal, df / ef AS pair_z_formal, least(x.sn_r, y.sn_r) AS sn_r_min,
    x.p AS program_1, y.p AS program_2, least(x.p, y.p) || ' / ' || greatest(x.p, y.p) AS program_pair, turn * d AS program_delta_vrad, turn * d / err AS program_pair_z,
    turn * df AS program_delta_vrad_formal, turn * df / ef AS program_pair_z_formal, x.s AS survey_1, y.s AS survey_2, x.fiber AS fiber_1, y.fiber AS fiber_2,
    x.night AS night_1, y.night AS night_2, x.tileid AS tileid_1, y.tileid AS tileid_2, NULL::DOUBLE AS teff_median, NULL::DOUBLE AS logg_median, NULL::DOUBLE AS feh_median
  FROM made
)
"""
)


def _calibration_sql(group: str | None, z: str, later: bool = False, source: str = "pairs_made") -> str:
    name, key = (group, group) if group else ("GROUP", "'all'")
    where = " AND delta_days > 1.0" if later else ""
    return f"""{_PAIRS if source == "pairs_made" else source}, z AS (SELECT {key} AS k, {z}::DOUBLE AS z FROM {"pairs_made" if source == "pairs_made" else "binned"} WHERE isfinite({z}){where}),
    m AS (SELECT *, median(z) OVER (PARTITION BY k) AS med FROM z)
    SELECT k AS "{name}", count(*) AS "N_PAIRS", round(median(z), 5) AS "MEDIAN_Z", round((quantile_cont(z, 0.84) - quantile_cont(z, 0.16)) / 2, 5) AS "ROBUST_WIDTH_Z",
      round(1.4826 * median(abs(z - med)), 5) AS "MAD_WIDTH_Z", round(quantile_cont(z, 0.16), 5) AS "Q16_Z", round(quantile_cont(z, 0.84), 5) AS "Q84_Z",
      round(avg((abs(z) > 3)::INT), 5) AS "TAIL_GT_3", round(avg((abs(z) > 5)::INT), 5) AS "TAIL_GT_5", '{z}' AS "Z_COLUMN" FROM m GROUP BY k"""


_BINNED = (
    _PAIRS
    + """, edges AS (
  SELECT list_distinct(quantile_cont(sn_r_min, [0.0, 0.16666666666666666, 0.3333333333333333, 0.5, 0.6666666666666666, 0.8333333333333334, 1.0])) AS es
  FROM pairs_made WHERE isfinite(sn_r_min)
),
bins AS (SELECT es[i] AS lo, es[i + 1] AS hi, i FROM (SELECT list_sort(es) AS es, unnest(range(1, len(es))) AS i FROM edges)),
binned AS (SELECT p.*, printf('(%.3f, %.3f]', lo, hi) AS "SN_R_MIN_BIN" FROM pairs_made p LEFT JOIN bins ON (sn_r_min > lo OR (i = 1 AND sn_r_min >= lo)) AND sn_r_min <= hi)
"""
)

_LABELS = r"""
WITH RECURSIVE once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY group_id NULLS FIRST, group_kind NULLS FIRST, delta_days NULLS FIRST, delta_vrad NULLS FIRST, pair_error NULLS FIRST, pair_error_formal NULLS FIRST, program_1 NULLS FIRST,
    program_2 NULLS FIRST, program_pair NULLS FIRST, night_1 NULLS FIRST, night_2 NULLS FIRST, exposure_key_1 NULLS FIRST, exposure_key_2 NULLS FIRST) AS k FROM pairs WHERE pair_id IS NOT NULL) WHERE k = 1),
parts AS (SELECT *, list_transform(string_split(upper(regexp_replace(program_pair, '^\s+|\s+$', '', 'g')), '/'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS pp FROM once),
clean AS (
  SELECT * EXCLUDE (program_1, program_2, night_1, night_2, program_pair), upper(regexp_replace(program_1, '^\s+|\s+$', '', 'g')) AS program_1, upper(regexp_replace(program_2, '^\s+|\s+$', '', 'g')) AS program_2,
    nullif(regexp_extract(regexp_replace(night_1, '[\s-]', '', 'g'), '^(\d{8})(\.0*)?$', 1), '') AS night_1,
    nullif(regexp_extract(regexp_replace(night_2, '[\s-]', '', 'g'), '^(\d{8})(\.0*)?$', 1), '') AS night_2,
    CASE WHEN len(pp) = 2 AND NOT list_contains(pp, '') THEN array_to_string(list_sort(pp), ' / ') END AS program_pair
  FROM parts
), rows AS (
  SELECT group_id, group_kind, trim(exposure_key_1) AS x1, trim(exposure_key_2) AS x2, program_1 AS p1, program_2 AS p2, coalesce(nullif(program_1, ''), 'UNKNOWN') || ':' || coalesce(night_1, 'UNKNOWN') AS l1, coalesce(nullif(program_2, ''), 'UNKNOWN') || ':' || coalesce(night_2, 'UNKNOWN') AS l2,
    program_pair, delta_vrad AS d, pair_error AS err, pair_error_formal AS formal, (('0x' || substr(md5(CAST(group_id AS VARCHAR)), 1, 8))::BIGINT % 5)::INT AS model
  FROM clean WHERE group_id IS NOT NULL AND isfinite(delta_vrad) AND isfinite(pair_error) AND isfinite(pair_error_formal) AND pair_error > 0 AND pair_error_formal > 0 AND delta_days > 1.0
), lp AS (SELECT * FROM rows WHERE l1 <> l2),
ends AS (SELECT model, label, count(*) AS n FROM (SELECT model, l1 AS label FROM lp UNION ALL SELECT model, l2 FROM lp) GROUP BY ALL)
"""

#: Exposures with their night in each of the shuffles.
_NIGHTS = (
    _LABELS
    + """, x AS (SELECT trim(exposure_key_1) AS k2, program_1 AS p, night_1 AS n FROM clean UNION ALL SELECT trim(exposure_key_2), program_2, night_2 FROM clean),
e AS (SELECT k2, min(p) AS p, min(n) AS n FROM x GROUP BY k2 HAVING min(p) IS NOT NULL),
s AS (SELECT seed::INT AS seed, e.*, count(*) OVER (PARTITION BY seed, p) AS size, row_number() OVER (PARTITION BY seed, p ORDER BY md5(k2), k2) AS a, row_number() OVER (PARTITION BY seed, p ORDER BY md5(seed || '|' || k2), k2) AS b FROM e CROSS JOIN range(20) t(seed)),
still AS (SELECT seed, p, bool_and(a = b) AS still FROM s GROUP BY ALL),
nights AS (SELECT v.seed, v.k2 AS key, w.n AS night FROM s v JOIN still t ON v.seed = t.seed AND v.p = t.p JOIN s w ON v.seed = w.seed AND v.p = w.p AND w.b = CASE WHEN still THEN (v.a - 2 + v.size) % v.size + 1 ELSE v.a END)
"""
)


def _solve_sql(name: str, work: str, weighted: str, damp: float, steps: int = 80) -> str:
    """{name}(step, model, label, x...): conjugate gradients on the normal equations of ``weighted``(model, l1, l2, d, w), for the labels of ``work``."""
    return f""", {name}_s AS MATERIALIZED (SELECT model, l1, l2, sum(w) AS w, sum(w * d) AS r FROM {weighted} GROUP BY ALL),
{name}_e AS MATERIALIZED (SELECT model, l1 AS i, l2 AS j, w, r FROM {name}_s UNION ALL SELECT model, l2, l1, w, -r FROM {name}_s),
{name}_v AS (SELECT model, l1 AS label FROM {work} UNION SELECT model, l2 FROM {work}),
{name}_d AS MATERIALIZED (SELECT v.model, v.label, coalesce(sum(w), 0) + {damp * damp!r} AS dg, coalesce(sum(r), 0) AS b FROM {name}_v v LEFT JOIN {name}_e e ON e.model = v.model AND e.i = v.label GROUP BY ALL),
{name} AS (
  SELECT 0 AS step, model, label, 0.0::DOUBLE AS x, b::DOUBLE AS r, (b / dg)::DOUBLE AS p FROM {name}_d
  UNION ALL
  SELECT step + 1, model, label, x + al * p, r2, r2 / dg + coalesce(rz2 / nullif(rz, 0), 0) * p FROM (SELECT *, sum(r2 * r2 / dg) OVER (PARTITION BY model) AS rz2 FROM (SELECT *, r - al * ap AS r2 FROM (
    SELECT *, coalesce(rz / nullif(pap, 0), 0) AS al FROM (SELECT q.*, dg, dg * p - coalesce(o, 0) AS ap, sum(r * r / dg) OVER (PARTITION BY q.model) AS rz, sum(p * (dg * p - coalesce(o, 0))) OVER (PARTITION BY q.model) AS pap
      FROM {name} q JOIN {name}_d USING (model, label) LEFT JOIN (SELECT e.model, e.i, sum(e.w * t.p) AS o FROM {name}_e e JOIN {name} t ON e.model = t.model AND e.j = t.label GROUP BY ALL) n ON n.model = q.model AND n.i = q.label
      WHERE step < {steps}))))
), {name}_x AS MATERIALIZED (SELECT model, label, x FROM {name} WHERE step = {steps})
"""


def _fit_sql(name: str, train: str, rounds: int = 3, damp: float = 0.2) -> str:
    """CTEs for models of training rows: {name}_offsets(model, label, x), {name}_comp(model, label, number), {name}_work, {name}_kept."""
    out = f""", {name}_t AS MATERIALIZED ({train}),
{name}_ends AS (SELECT model, label FROM (SELECT model, l1 AS label FROM {name}_t UNION ALL SELECT model, l2 FROM {name}_t) GROUP BY ALL HAVING count(*) >= {LEAST_PAIRS}),
{name}_work AS MATERIALIZED (SELECT t.* FROM {name}_t t JOIN {name}_ends a ON a.model = t.model AND a.label = l1 JOIN {name}_ends b ON b.model = t.model AND b.label = l2 WHERE abs(d / err) <= 5),
{name}_both AS (SELECT DISTINCT model, l1 AS a, l2 AS b FROM {name}_work UNION SELECT model, l2, l1 FROM {name}_work),
{name}_reach(model, node, other) AS (SELECT model, a, a FROM {name}_both UNION SELECT q.model, q.node, e.b FROM {name}_reach q JOIN {name}_both e ON e.model = q.model AND q.other = e.a),
{name}_comp AS MATERIALIZED (SELECT model, node AS label, dense_rank() OVER (PARTITION BY model ORDER BY min(other)) - 1 AS number FROM {name}_reach GROUP BY model, node)
"""
    for k in range(rounds + 1):
        kept = f"{name}_work"
        if k:
            kept = f"{name}_kept{k}"
            out += f", {kept} AS MATERIALIZED (SELECT t.* FROM {name}_work t JOIN {name}{k - 1}_x a ON a.model = t.model AND a.label = l1 JOIN {name}{k - 1}_x b ON b.model = t.model AND b.label = l2 WHERE abs((d - (a.x - b.x)) / err) <= 3.5)\n"
        out += f", {name}_w{k} AS MATERIALIZED (SELECT model, l1, l2, d, 1 / (err * err * count(*) OVER (PARTITION BY model, group_id)) AS w FROM {kept})\n"
        out += _solve_sql(f"{name}{k}", f"{name}_work", f"{name}_w{k}", damp)
    return out + f", {name}_offsets AS (SELECT * FROM {name}{rounds}_x), {name}_kept AS (SELECT * FROM {name}_w{rounds})\n"


def _metrics_sql(side: str) -> str:
    z = f"({side} / sqrt(v))"
    width = lambda x, n=4: f"round((quantile_cont({x}, 0.84) - quantile_cont({x}, 0.16)) / 2, {n})"
    digits = 7 if side == "before" else 4
    return (
        f"{width(side, digits)} AS raw_width_{side}, round(median({side}), {digits}) AS median_{side}, round(median({z}), 4) AS median_z_{side}, {width(z)} AS width_z_{side}, "
        f"round(avg((abs({z}) > 3)::INT), 4) AS tail_3_{side}, round(avg((abs({z}) > 5)::INT), 4) AS tail_5_{side}, round(avg(0.5 * ({z} * {z} + ln(2 * pi() * v))), 4) AS loss_{side}"
    )


def _folds_sql(train: str, holdout: str, models: int) -> str:
    """CTEs of a cross-validation: offsets, comp, scored, by_program and what _SUMMARY_SQL needs."""
    width = "pow((quantile_cont(r, 0.84) - quantile_cont(r, 0.16)) / 2, 2)"
    exact = lambda x, q: f"(quantile_cont({x}, 0.84) - quantile_cont({x}, 0.16)) / 2" if q == "w" else f"avg(0.5 * ({x} * {x} + ln(2 * pi() * v)))"
    return (
        _fit_sql("m", train)
        + f""", held AS (SELECT h.*, a.x - b.x AS change, coalesce(ca.number = cb.number, false) AS same FROM ({holdout}) h
  LEFT JOIN m_offsets a ON a.model = h.model AND a.label = l1 LEFT JOIN m_offsets b ON b.model = h.model AND b.label = l2
  LEFT JOIN m_comp ca ON ca.model = h.model AND ca.label = l1 LEFT JOIN m_comp cb ON cb.model = h.model AND cb.label = l2),
resid AS MATERIALIZED (SELECT t.model, program_pair AS p, d - (a.x - b.x) AS r, formal * formal AS f2 FROM m_t t JOIN m_offsets a ON a.model = t.model AND a.label = l1 JOIN m_offsets b ON b.model = t.model AND b.label = l2),
overall AS (SELECT model, sqrt(greatest({width} - median(f2), 0)) AS f FROM resid GROUP BY model),
floors AS (SELECT resid.model, p, CASE WHEN count(*) >= {LEAST_PAIRS} THEN sqrt(greatest({width} - median(f2), 0)) ELSE any_value(overall.f) END AS floor FROM resid JOIN overall USING (model) GROUP BY resid.model, p),
usual AS (SELECT model, median(floor) AS u FROM floors GROUP BY model),
scored AS MATERIALIZED (SELECT h.model, h.program_pair AS p, d AS before, d - change AS after, coalesce(floor, u, 0) AS floor, formal * formal + pow(coalesce(floor, u, 0), 2) AS v
  FROM held h LEFT JOIN floors f ON f.model = h.model AND f.p IS NOT DISTINCT FROM h.program_pair LEFT JOIN usual u ON u.model = h.model WHERE same),
by_program AS (SELECT model, p, count(*) AS n, {_metrics_sql("before")}, {_metrics_sql("after")}, round(max(floor), 4) AS train_pair_floor FROM scored GROUP BY model, p),
exact AS (SELECT model, p, {exact("(before / sqrt(v))", "w")} AS wb, {exact("(after / sqrt(v))", "w")} AS wa, {exact("(before / sqrt(v))", "l")} AS lb, {exact("(after / sqrt(v))", "l")} AS la FROM scored GROUP BY model, p),
macro AS (SELECT model, round(avg(wb), 4) AS macro_width_z_before, round(avg(wa), 4) AS macro_width_z_after, round(avg(lb), 4) AS macro_loss_before, round(avg(la), 4) AS macro_loss_after FROM exact GROUP BY model),
counts AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE same) AS ns FROM held GROUP BY model),
labelled AS (SELECT model, number, count(*) AS n FROM m_comp GROUP BY ALL), sizes_of AS (SELECT model, sum(n)::BIGINT AS nl, count(*) AS nc, max(n) / sum(n) AS fl FROM labelled GROUP BY model),
paired AS (SELECT w.model, number, count(*) AS n FROM m_work w JOIN m_comp c ON c.model = w.model AND c.label = l1 GROUP BY ALL), pair_share AS (SELECT model, max(n) / sum(n) AS fp FROM paired GROUP BY model),
errors AS (SELECT w.model, count(*) AS nt, sqrt(sum(w.w * pow(d - (a.x - b.x), 2))) AS r1 FROM m_kept w JOIN m_offsets a ON a.model = w.model AND a.label = l1 JOIN m_offsets b ON b.model = w.model AND b.label = l2 GROUP BY w.model),
whole AS (SELECT model, {_metrics_sql("before")}, {_metrics_sql("after")} FROM scored GROUP BY model), models AS (SELECT range::INT AS model FROM range({models})),
offsets AS (SELECT * FROM m_offsets), comp AS (SELECT * FROM m_comp)
"""
    )


_FOLDS = _LABELS + _folds_sql("SELECT f::INT AS model, * EXCLUDE (model) FROM lp CROSS JOIN range(5) t(f) WHERE model <> f", "SELECT * FROM lp", 5)
_SUMMARY_SQL = """SELECT model AS fold, coalesce(counts.n, 0) AS n_holdout_pairs, coalesce(ns, 0) AS n_holdout_same_component, coalesce(nl, 0) AS n_labels, coalesce(nc, 0) AS n_components, round(fl, 4) AS largest_component_label_fraction,
  coalesce(nt, 0) AS n_train_pairs, round(r1, 4) AS r1norm, round(fp, 4) AS largest_component_pair_fraction, coalesce(counts.n, 0) - coalesce(ns, 0) AS n_holdout_cross_component, whole.* EXCLUDE (model), macro.* EXCLUDE (model)
  FROM models LEFT JOIN counts USING (model) LEFT JOIN sizes_of USING (model) LEFT JOIN errors USING (model) LEFT JOIN pair_share USING (model) LEFT JOIN whole USING (model) LEFT JOIN macro USING (model)"""

_DIMS = ("program", "night", "tileid", "expid", "fiber")
#: Zero points of the made pairs: labels, kept, offsets and scored, by dimension (run).
_ZEROS = (
    _PAIRS.replace("WITH first", "WITH RECURSIVE first")
    + ", dims(run) AS (VALUES "
    + ", ".join(f"('{d.upper()}')" for d in _DIMS)
    + "), ends AS MATERIALIZED ("
    + " UNION ALL ".join(
        f"SELECT '{d.upper()}' AS run, group_id, coalesce(trim(CAST({d}_1 AS VARCHAR)), '') AS l1, coalesce(trim(CAST({d}_2 AS VARCHAR)), '') AS l2, program_pair AS p, delta_vrad AS d, pair_error AS err, pair_z AS z, delta_days FROM pairs_made" for d in _DIMS
    )
    + f"""), usable AS MATERIALIZED (SELECT *, ('0x' || substr(md5(coalesce(CAST(group_id AS VARCHAR), '')), 1, 8))::BIGINT % 1000 < 500 AS train FROM ends WHERE isfinite(d) AND isfinite(err) AND err > 0 AND l1 <> '' AND l2 <> '' AND delta_days > 1.0),
trained AS (SELECT * FROM usable WHERE train AND abs(z) <= 5),
labels AS MATERIALIZED (SELECT run, label, count(*) AS n FROM (SELECT run, l1 AS label FROM trained UNION ALL SELECT run, l2 FROM trained) GROUP BY ALL HAVING count(*) >= {LEAST_PAIRS}),
kept AS MATERIALIZED (SELECT t.*, run AS model, 1 / (err * err) AS w FROM trained t WHERE l1 <> l2 AND (run, l1) IN (SELECT (run, label) FROM labels) AND (run, l2) IN (SELECT (run, label) FROM labels))
"""
    + _solve_sql("c", "kept", "kept", 0.05, 400)
    + """, raw AS (SELECT run, labels.label AS label, n, coalesce(x, 0.0) AS x FROM labels LEFT JOIN c_x ON c_x.model = run AND c_x.label = labels.label WHERE run IN (SELECT run FROM kept)),
solved AS MATERIALIZED (SELECT run, label, n, x - median(x) OVER (PARTITION BY run) AS x FROM raw),
scored AS (SELECT u.run, p, u.run IN (SELECT run FROM solved) AS fitted, z AS za, CASE WHEN u.run IN (SELECT run FROM solved) THEN (d - (coalesce(a.x, 0) - coalesce(b.x, 0))) / err ELSE z END AS zb
  FROM usable u LEFT JOIN solved a ON a.run = u.run AND a.label = l1 LEFT JOIN solved b ON b.run = u.run AND b.label = l2 WHERE NOT train)
"""
)
_Z_COLUMNS = ", ".join(
    f"round(avg((abs({c}) > 3)::INT) FILTER (WHERE isfinite({c})), 4) AS tail_3_{side}, round(avg((abs({c}) > 5)::INT) FILTER (WHERE isfinite({c})), 4) AS tail_5_{side}, "
    f"round(median({c}) FILTER (WHERE isfinite({c})), 4) AS median_z_{side}, round((quantile_cont({c}, 0.84) FILTER (WHERE isfinite({c})) - quantile_cont({c}, 0.16) FILTER (WHERE isfinite({c}))) / 2, 4) AS width_z_{side}"
    for c, side in (("za", "before"), ("zb", "after"))
) + (
    ", (quantile_cont(za, 0.84) FILTER (WHERE isfinite(za)) - quantile_cont(za, 0.16) FILTER (WHERE isfinite(za))) / 2 AS wb, (quantile_cont(zb, 0.84) FILTER (WHERE isfinite(zb)) - quantile_cont(zb, 0.16) FILTER (WHERE isfinite(zb))) / 2 AS wa, "
    "avg((abs(za) > 5)::INT) FILTER (WHERE isfinite(za)) AS t5b, avg((abs(zb) > 5)::INT) FILTER (WHERE isfinite(zb)) AS t5a"
)

_PAIR_DOUBLES = {
    "MJD_1", "MJD_2", "DELTA_DAYS", "SN_R_MIN", "TEFF_MEDIAN", "LOGG_MEDIAN", "FEH_MEDIAN",
    *[c for c in pairs.PAIR_COLUMNS if c.startswith(("VRAD", "DELTA_VRAD", "PAIR_", "PROGRAM_DELTA", "PROGRAM_PAIR_Z"))],
}

ORACLES: dict[str, str] = {
    "p1_found": _READINGS,
    "p4_found": _REFERENCES + "SELECT ref_table, obs_id FROM judged WHERE NOT in_force",
    "p4_by_night": _REFERENCES
    + """SELECT ref_table, night, count(*) AS n_references, count(*) FILTER (WHERE NOT in_force) AS n_orphans,
      count(*) FILTER (WHERE NOT known) AS n_unknown FROM judged GROUP BY ref_table, night""",
    "p4_by_tile": _REFERENCES
    + """, made AS (
      SELECT obs.tileid, count(*) AS n_backup_epochs_found, count(*) FILTER (WHERE j.obs_id IS NULL) AS n_unmatched_found
      FROM obs LEFT JOIN (SELECT obs_id FROM judged WHERE ref_table = 'backup_correction' AND known) j USING (obs_id)
      WHERE is_main_backup GROUP BY obs.tileid
    ), stated AS (SELECT DISTINCT tileid, run_night, n_backup_epochs_unmatched AS n_unmatched_stated FROM correction_summary)
    SELECT tileid, run_night, n_unmatched_stated, n_backup_epochs_found, n_unmatched_found, n_unmatched_found = n_unmatched_stated AS agrees
    FROM stated FULL JOIN made USING (tileid)""",
    "epochs": _EPOCHS + 'SELECT obs_id AS "OBS_ID", targetid AS "TARGETID", source_id AS "SOURCE_ID", group_id AS "GROUP_ID", group_kind AS "GROUP_KIND", mjd AS "MJD", vrad AS "VRAD", vrad_err AS "VRAD_ERR" FROM judged',
    "adopted_velocity": _EPOCHS
    + 'SELECT obs_id AS "OBS_ID", round(vrad_offset, 5) AS "VRAD_OFFSET", round(vrad_floor, 5) AS "VRAD_FLOOR", round(v, 5) AS "VRAD_ADOPTED", round(e, 5) AS "VRAD_ERR_ADOPTED" FROM judged',
    "correction_coverage": _EPOCHS
    + """SELECT count(*) FILTER (WHERE backup) AS "N_BACKUP_EPOCHS", count(*) FILTER (WHERE backup AND matched) AS "N_BACKUP_EPOCHS_MATCHED",
      count(*) FILTER (WHERE backup AND NOT matched) AS "N_BACKUP_EPOCHS_UNMATCHED", count(*) FILTER (WHERE NOT backup AND matched) AS "N_NON_BACKUP_TARGETID_MATCHES" FROM judged""",
    "correction_conflicts": """SELECT targetid AS "TARGETID", count(DISTINCT vrad_offset) AS "N_OFFSETS" FROM backup_correction
      WHERE targetid IS NOT NULL AND vrad_offset IS NOT NULL AND NOT isnan(vrad_offset) GROUP BY targetid HAVING count(DISTINCT vrad_offset) > 1""",
    "quality_filtered": _EPOCHS + 'SELECT obs_id AS "OBS_ID" FROM judged WHERE good',
    "rejection_counts": _EPOCHS
    + """, counts AS (SELECT count(*) AS n, [sum(r1::INT), sum(r2::INT), sum(r3::INT), sum(r4::INT), sum(r5::INT), sum(r6::INT), sum(r7::INT), sum(r8::INT), sum(r9::INT)] AS cs FROM judged),
      names AS (SELECT ['NONFINITE_RV', 'INVALID_RV_ERROR', 'EXTREME_ABS_RV', 'LOW_SN_R', 'FIT_NOT_SUCCESSFUL', 'NON_STELLAR_RR_SPECTYPE', 'RVS_WARNING', 'MISSING_VSINI', 'HIGH_VSINI'] AS ns)
      SELECT ns[i] AS "REASON", cs[i]::BIGINT AS "N_REJECTED", round(cs[i] / greatest(n, 1), 5)::DOUBLE AS "FRACTION" FROM counts, names, range(1, 10) t(i)""",
    "epoch_quality": _EPOCHS
    + r""", k AS (SELECT *, upper(regexp_replace(survey, '^\s+|\s+$', '', 'g')) AS su, upper(regexp_replace(program, '^\s+|\s+$', '', 'g')) AS pr FROM judged),
      twice AS (SELECT su, pr, count(*) AS n2 FROM (SELECT su, pr, group_id FROM k WHERE good GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
      all_ AS (SELECT su, pr, count(*) AS a, count(DISTINCT targetid) AS b, count(DISTINCT group_id) AS c, count(*) FILTER (WHERE good) AS d,
        count(DISTINCT targetid) FILTER (WHERE good) AS e, count(DISTINCT group_id) FILTER (WHERE good) AS f FROM k GROUP BY ALL)
      SELECT x.su AS "SURVEY", x.pr AS "PROGRAM", a AS "N_EPOCHS_RAW", b AS "N_TARGETIDS_RAW", c AS "N_GROUPS_RAW", d AS "N_EPOCHS_GOOD", e AS "N_TARGETIDS_GOOD", f AS "N_GROUPS_GOOD",
        coalesce(n2, 0) AS "N_GROUPS_2PLUS_GOOD_EPOCHS", round(d / a, 5) AS "GOOD_EPOCH_FRACTION" FROM all_ x LEFT JOIN twice y ON x.su IS NOT DISTINCT FROM y.su AND x.pr IS NOT DISTINCT FROM y.pr""",
    "reference_velocity_conflicts": """SELECT targetid AS "TARGETID", count(DISTINCT v) AS "N_OFFSETS" FROM (SELECT targetid, vrad_offset AS v FROM backup_correction UNION ALL SELECT targetid, radial_velocity FROM gaia)
      WHERE targetid IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) GROUP BY targetid HAVING count(DISTINCT v) > 1""",
    "source_summary": _SOURCES + "SELECT * FROM summed",
    "source_p_values": _SOURCES + "SELECT group_id, dof, chi2_const, p_const, log_p_const, evidence_score FROM summed",
    "classification_counts": _SOURCES + "SELECT classification, count(*) AS n_sources FROM classed GROUP BY classification",
    "strict_candidates": _SOURCES + "SELECT * FROM summed WHERE classification = 'candidate_variable' AND n_epochs_good >= 3 AND time_baseline_days > 1",
    "top_candidates": _SOURCES + "SELECT * FROM summed WHERE classification = 'candidate_variable' ORDER BY evidence_score DESC NULLS LAST, max_pair_sigma DESC NULLS LAST, group_id LIMIT 10",
    "pair_table": _PAIRS
    + "SELECT "
    + ", ".join(f'round({c.lower()}, 4) AS "{c}"' if c in _PAIR_DOUBLES else f'{c.lower()} AS "{c}"' for c in pairs.PAIR_COLUMNS)
    + " FROM pairs_made",
    "calibration_overall": _calibration_sql(None, "PAIR_Z"),
    "calibration_overall_formal": _calibration_sql(None, "PAIR_Z_FORMAL"),
    "calibration_by_program": _calibration_sql("PROGRAM_PAIR", "PROGRAM_PAIR_Z"),
    "calibration_by_program_formal": _calibration_sql("PROGRAM_PAIR", "PROGRAM_PAIR_Z_FORMAL"),
    "calibration_interday": _calibration_sql("PROGRAM_PAIR", "PROGRAM_PAIR_Z", True),
    "calibration_interday_formal": _calibration_sql("PROGRAM_PAIR", "PROGRAM_PAIR_Z_FORMAL", True),
    "calibration_by_sn": _calibration_sql('"SN_R_MIN_BIN"', "PAIR_Z", source=_BINNED).replace('AS ""SN_R_MIN_BIN""', 'AS "SN_R_MIN_BIN"'),
    "residual_histogram": _PAIRS
    + """, z AS (SELECT 'PAIR_Z' AS c, pair_z AS z FROM pairs_made UNION ALL SELECT 'PAIR_Z_FORMAL', pair_z_formal FROM pairs_made),
      b AS (SELECT c, least(floor((z + 8) / 0.125), 127)::BIGINT AS b, count(*) AS n FROM z WHERE z >= -8 AND z <= 8 GROUP BY ALL)
      SELECT c AS "Z_COLUMN", b AS "BIN", b * 0.125::DOUBLE - 8 AS "BIN_LOW", n AS "N", round(n / (sum(n) OVER (PARTITION BY c) * 0.125::DOUBLE), 5) AS "DENSITY" FROM b""",
    "program_pair_counts": _PAIRS
    + """SELECT count(*) FILTER (WHERE program_1 = 'BACKUP' OR program_2 = 'BACKUP') AS "N_PAIRS_WITH_PROGRAM",
      count(*) FILTER (WHERE (program_1 = 'BACKUP') <> (program_2 = 'BACKUP')) AS "N_CROSS_PROGRAM_PAIRS" FROM pairs_made""",
    "report_headline": _PAIRS
    + """SELECT count(*) AS "N_PAIRS", round(median(pair_z), 5) AS "MEDIAN_Z", round((quantile_cont(pair_z, 0.84) - quantile_cont(pair_z, 0.16)) / 2, 5) AS "ROBUST_WIDTH_Z",
      round(avg((abs(pair_z) > 5)::INT), 5) AS "TAIL_GT_5" FROM pairs_made WHERE isfinite(pair_z)""",
    "label_pairs": _LABELS + 'SELECT group_id AS "GROUP_ID", group_kind AS "GROUP_KIND", l1 AS "L1", l2 AS "L2", program_pair AS "PROGRAM_PAIR", round(d, 5) AS d, round(err, 5) AS err, round(formal, 5) AS formal, model FROM lp',
    "label_endpoint_counts": _LABELS + "SELECT model, label, n FROM ends",
    "kept_label_pairs": _LABELS
    + f"""SELECT model, l1 AS "L1", l2 AS "L2", group_id AS "GROUP_ID", group_kind AS "GROUP_KIND", program_pair AS "PROGRAM_PAIR", round(d, 5) AS d, round(err, 5) AS err, round(formal, 5) AS formal FROM lp
      WHERE (model, l1) IN (SELECT (model, label) FROM ends WHERE n >= {LEAST_PAIRS}) AND (model, l2) IN (SELECT (model, label) FROM ends WHERE n >= {LEAST_PAIRS}) AND abs(d / err) <= 5""",
    "label_pair_sums": _LABELS
    + """, w AS (SELECT *, 1 / (err * err * count(*) OVER (PARTITION BY model, group_id)) AS w, CASE WHEN l1 <= l2 THEN d ELSE -d END AS dd FROM lp)
      SELECT model, least(l1, l2) AS "L1", greatest(l1, l2) AS "L2", round(sum(w), 5) AS s0, round(sum(w * dd), 5) AS s1, round(sum(w * dd * dd), 5) AS s2, count(*) AS n FROM w GROUP BY ALL""",
    "robust_metrics": _LABELS
    + """, z AS (SELECT program_pair AS p, d, formal * formal AS v, d / formal AS z FROM lp)
      SELECT p AS "PROGRAM_PAIR", count(*) AS n, round((quantile_cont(d, 0.84) - quantile_cont(d, 0.16)) / 2, 5) AS raw_width, round(median(d), 5) AS median, round(median(z), 5) AS median_z,
        round((quantile_cont(z, 0.84) - quantile_cont(z, 0.16)) / 2, 5) AS width_z, round(avg((abs(z) > 3)::INT), 5) AS tail_3, round(avg((abs(z) > 5)::INT), 5) AS tail_5,
        round(avg(0.5 * (z * z + ln(2 * pi() * v))), 5) AS loss FROM z GROUP BY p""",
    "pair_floors": _LABELS
    + f""", own AS (SELECT model, program_pair AS p, count(*) AS n, sqrt(greatest(pow((quantile_cont(d, 0.84) - quantile_cont(d, 0.16)) / 2, 2) - median(formal * formal), 0)) AS f FROM lp GROUP BY ALL),
      overall AS (SELECT model, sqrt(greatest(pow((quantile_cont(d, 0.84) - quantile_cont(d, 0.16)) / 2, 2) - median(formal * formal), 0)) AS f FROM lp GROUP BY ALL)
      SELECT own.model, p AS "PROGRAM_PAIR", round(CASE WHEN n >= {LEAST_PAIRS} THEN own.f ELSE overall.f END, 5) AS floor FROM own JOIN overall USING (model)""",
    "exposure_conflicts": _LABELS
    + """, x AS (SELECT trim(exposure_key_1) AS k2, coalesce(night_1, '') AS n FROM clean UNION ALL SELECT trim(exposure_key_2), coalesce(night_2, '') FROM clean)
      SELECT k2 AS "EXPOSURE_KEY", count(DISTINCT n) AS "N_NIGHTS" FROM x GROUP BY k2 HAVING count(DISTINCT n) > 1""",
    "exposure_nights": _NIGHTS + 'SELECT seed, key AS "EXPOSURE_KEY", night AS "NIGHT" FROM nights',
    "fold_summary": _FOLDS + _SUMMARY_SQL,
    "fold_by_program": _FOLDS + "SELECT model AS fold, * EXCLUDE (model, p), p AS \"PROGRAM_PAIR\" FROM by_program",
    "fold_offsets": _FOLDS + "SELECT model AS fold, label, round(x, 4) AS \"offset\", number AS component FROM offsets JOIN comp USING (model, label)",
    "label_experiment": _FOLDS
    + _fit_sql("h", "SELECT (('0x' || substr(md5(CAST(group_id AS VARCHAR)), 1, 8))::BIGINT % 2)::INT AS model, * EXCLUDE (model) FROM lp")
    + """, shared AS (SELECT count(*) AS n_label_pairs, count(*) FILTER (WHERE group_kind = 'GAIA_SOURCE_ID') AS n_gaia_group_pairs, round(avg((coalesce(group_kind, '') = 'GAIA_SOURCE_ID')::INT), 4) AS gaia_group_pair_fraction FROM lp),
      both_halves AS (SELECT ca.number AS c0, cb.number AS c1, count(*) AS n FROM h_comp ca JOIN h_comp cb ON ca.label = cb.label AND ca.model = 0 AND cb.model = 1 GROUP BY ALL)
      SELECT fold, shared.*, n_train_pairs, raw_width_before, raw_width_after, (SELECT n FROM both_halves ORDER BY n DESC, c0, c1 LIMIT 1) AS n_common_labels FROM ("""
    + _SUMMARY_SQL
    + ") CROSS JOIN shared",
    "half_reproducibility": _LABELS
    + _fit_sql("h", "SELECT (('0x' || substr(md5(CAST(group_id AS VARCHAR)), 1, 8))::BIGINT % 2)::INT AS model, * EXCLUDE (model) FROM lp")
    + """, matched AS (SELECT a.x AS x, b.x AS y, ca.number AS c0, cb.number AS c1 FROM h_offsets a JOIN h_offsets b ON a.label = b.label AND a.model = 0 AND b.model = 1
        JOIN h_comp ca ON ca.model = 0 AND ca.label = a.label JOIN h_comp cb ON cb.model = 1 AND cb.label = b.label),
      most AS (SELECT c0, c1 FROM matched GROUP BY ALL ORDER BY count(*) DESC, c0, c1 LIMIT 1), chosen AS (SELECT matched.*, median(y - x) OVER () AS shift FROM matched JOIN most USING (c0, c1)),
      moved AS (SELECT x, y - shift AS y, shift, c0, c1 FROM chosen)
      SELECT count(*) AS n_labels, max(c0 || '/' || c1) AS component_pair, round(max(shift), 4) AS shift, round(corr(x, y), 4) AS correlation, round(sum(x * y) / greatest(sum(x * x), 1e-12), 4) AS slope,
        round(median(abs(x - y)), 4) AS median_abs_difference, round((quantile_cont(x - y, 0.84) - quantile_cont(x - y, 0.16)) / 2, 4) AS difference_width FROM moved""",
    "permutation_control": _NIGHTS
    + """, lp2 AS (SELECT t.seed, r.* EXCLUDE (l1, l2), coalesce(nullif(p1, ''), 'UNKNOWN') || ':' || coalesce(a.night, 'UNKNOWN') AS l1, coalesce(nullif(p2, ''), 'UNKNOWN') || ':' || coalesce(b.night, 'UNKNOWN') AS l2
        FROM rows r CROSS JOIN range(20) t(seed) LEFT JOIN nights a ON a.key = r.x1 AND a.seed = t.seed LEFT JOIN nights b ON b.key = r.x2 AND b.seed = t.seed),
      lps AS (SELECT * FROM lp2 WHERE l1 <> l2)"""
    + _folds_sql("SELECT seed * 5 + f AS model, * EXCLUDE (model) FROM lps CROSS JOIN range(5) t(f) WHERE model <> f", "SELECT seed * 5 + model AS model, * EXCLUDE (model) FROM lps", 100)
    + "SELECT (fold // 5)::INT AS permutation, (fold % 5)::INT AS fold, * EXCLUDE (fold), 'SHUFFLED_EXPOSURE_NIGHT_WITHIN_PROGRAM' AS \"CONTROL\" FROM ("
    + _SUMMARY_SQL
    + ")",
    "zero_point_summary": _ZEROS
    + """, z AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE isfinite(za)) AS nf, bool_or(fitted) AS fitted, """
    + _Z_COLUMNS
    + """ FROM scored GROUP BY run)
      SELECT d.run AS dimension, coalesce(l.n, 0) AS n_labels, coalesce(t.n, 0)::BIGINT AS n_train_pairs, coalesce(CASE WHEN fitted THEN nf ELSE z.n END, 0) AS n_holdout_pairs, round(o.m, 4) AS max_abs_offset, z.* EXCLUDE (run, n, nf, fitted, wb, wa, t5b, t5a),
        round(wa - wb, 4) AS delta_width_z, round(t5a - t5b, 4) AS delta_tail_5
      FROM dims d LEFT JOIN (SELECT run, count(*) AS n FROM labels GROUP BY run) l USING (run) LEFT JOIN (SELECT run, count(*) AS n FROM kept GROUP BY run) t USING (run)
        LEFT JOIN (SELECT run, max(abs(x)) AS m FROM solved GROUP BY run) o USING (run) LEFT JOIN z USING (run)""",
    "zero_point_by_program": _ZEROS
    + """ SELECT run AS dimension, p AS "PROGRAM_PAIR", count(*) FILTER (WHERE isfinite(za)) AS n_before, count(*) FILTER (WHERE isfinite(zb)) AS n_after, """
    + _Z_COLUMNS.split(", (quantile_cont(za")[0]
    + " FROM scored WHERE fitted GROUP BY run, p",
    "zero_point_offsets": _ZEROS + 'SELECT run AS dimension, label, round(x, 4) AS "offset", n AS n_endpoints FROM solved',
    "calibration_tables": _BINNED
    + ", tables AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS t, {group} AS g, {z} AS z, '{z.upper()}' AS c FROM binned WHERE isfinite({z}){' AND delta_days > 1.0' if later else ''}"
        for name, later, group, z in (
            ("calibration_overall", False, "'all'", "pair_z"), ("calibration_overall_formal", False, "'all'", "pair_z_formal"),
            ("calibration_by_program", False, "program_pair", "program_pair_z"), ("calibration_by_program_formal", False, "program_pair", "program_pair_z_formal"),
            ("calibration_interday", True, "program_pair", "program_pair_z"), ("calibration_interday_formal", True, "program_pair", "program_pair_z_formal"),
            ("calibration_by_sn", False, '"SN_R_MIN_BIN"', "pair_z"),
        )
    )
    + """), m AS (SELECT *, median(z) OVER (PARTITION BY t, g) AS med FROM tables)
      SELECT t AS "TABLE", g AS "GROUP", count(*) AS "N_PAIRS", round(median(z), 5) AS "MEDIAN_Z", round((quantile_cont(z, 0.84) - quantile_cont(z, 0.16)) / 2, 5) AS "ROBUST_WIDTH_Z",
        round(1.4826 * median(abs(z - med)), 5) AS "MAD_WIDTH_Z", round(quantile_cont(z, 0.16), 5) AS "Q16_Z", round(quantile_cont(z, 0.84), 5) AS "Q84_Z",
        round(avg((abs(z) > 3)::INT), 5) AS "TAIL_GT_3", round(avg((abs(z) > 5)::INT), 5) AS "TAIL_GT_5", c AS "Z_COLUMN" FROM m GROUP BY t, g, c""",
    "pair_cap_sweep": _PAIRS.replace("chosen AS (", "caps(cap) AS (VALUES (10), (20), (50)), chosen AS (")
    .replace("SELECT group_id, CASE WHEN np <= 50", "SELECT cap, group_id, CASE WHEN np <= cap")
    .replace("WHEN i = 49 THEN np - 1 ELSE floor(i * ((np - 1)::DOUBLE / 49.0))", "WHEN i = cap - 1 THEN np - 1 ELSE floor(i * ((np - 1)::DOUBLE / (cap - 1)))")
    .replace("FROM sizes CROSS JOIN range(50) t(i) WHERE np > 50 OR i < np", "FROM sizes CROSS JOIN caps CROSS JOIN range(50) t(i) WHERE i < cap AND (np > cap OR i < np)")
    .replace("SELECT x, y, x.v - y.v AS d", "SELECT cap, x, y, x.v - y.v AS d")
    .replace("SELECT x.group_id AS group_id,", "SELECT cap, x.group_id AS group_id,")
    + """SELECT cap AS "CAP", count(*) AS "N_PAIRS", round(median(pair_z), 5) AS "MEDIAN_Z", round((quantile_cont(pair_z, 0.84) - quantile_cont(pair_z, 0.16)) / 2, 5) AS "ROBUST_WIDTH_Z",
      round(avg((abs(pair_z) > 5)::INT), 5) AS "TAIL_GT_5" FROM pairs_made WHERE isfinite(pair_z) GROUP BY cap""",
}
