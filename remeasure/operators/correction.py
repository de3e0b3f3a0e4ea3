"""Velocity offsets by key and error floors by program."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_label

# Error floors in km/s.
FLOORS = {"BRIGHT": 1.0, "BACKUP": 2.0, "DARK": 1.6}
OFFSET_NAMES = ("VRAD_OFFSET", "VRAD_BIAS", "OFFSET", "BIAS")


def clean_correction(df: DataFrame) -> DataFrame:
    """(TARGETID, VRAD_OFFSET) from the first known offset column; rows without either are left out."""
    df = df.toDF(*[c.strip().upper() for c in df.columns])
    offset = next((c for c in OFFSET_NAMES if c in df.columns), None)
    if "TARGETID" not in df.columns or offset is None:
        raise ValueError("A correction needs TARGETID and VRAD_OFFSET or VRAD_BIAS")
    value = F.col(offset).try_cast("double")
    rows = df.select(F.col("TARGETID").try_cast("bigint").alias("TARGETID"), F.when(~F.isnan(value), value).alias("VRAD_OFFSET"))
    return rows.where("TARGETID is not null and VRAD_OFFSET is not null")


def correction_conflicts(correction: DataFrame) -> DataFrame:
    """(TARGETID, N_OFFSETS) of keys with more than one offset."""
    return correction.groupBy("TARGETID").agg(F.countDistinct("VRAD_OFFSET").alias("N_OFFSETS")).where("N_OFFSETS > 1")


def unique_correction(correction: DataFrame) -> DataFrame:
    """One row for each key; a ValueError if offsets conflict."""
    examples = [str(r["TARGETID"]) for r in correction_conflicts(correction).orderBy("TARGETID").limit(5).collect()]
    if examples:
        raise ValueError(f"The correction has conflicting offsets; examples: {', '.join(examples)}")
    return correction.groupBy("TARGETID").agg(F.min("VRAD_OFFSET").alias("VRAD_OFFSET"))


def agreeing_correction(correction: DataFrame) -> DataFrame:
    """The keys whose offsets agree, once each."""
    offsets = correction.groupBy("TARGETID").agg(F.min("VRAD_OFFSET").alias("VRAD_OFFSET"), F.max("VRAD_OFFSET").alias("_high"))
    return offsets.where("VRAD_OFFSET = _high").drop("_high")


def apply_velocity_calibration(epochs: DataFrame, correction: DataFrame | None = None, floors: dict[str, float] | None = None) -> DataFrame:
    """``epochs`` with VRAD_OFFSET, VRAD_ADOPTED, VRAD_FLOOR, VRAD_ERR_ADOPTED and HAS_CORRECTION.

    Offsets apply to main-survey backup epochs only, 0 where there is none. ``correction`` has one
    row for each key. Spark picks the join from the size of the correction.
    """
    label = lambda c: F.coalesce(clean_label(F.col(c)), F.lit("")) if c in epochs.columns else F.lit("")
    backup = (label("SURVEY") == "MAIN") & (label("PROGRAM") == "BACKUP")
    kept = epochs.drop("VRAD_OFFSET", "VRAD_ADOPTED", "VRAD_FLOOR", "VRAD_ERR_ADOPTED", "HAS_CORRECTION")
    if correction is None:
        matched = kept.withColumns({"_offset": F.lit(None).cast("double"), "HAS_CORRECTION": F.lit(False)})
    else:
        right = correction.select(F.col("TARGETID").alias("_key"), F.col("VRAD_OFFSET").alias("_offset"))
        matched = kept.join(right, F.col("TARGETID") == F.col("_key"), "left").withColumn("HAS_CORRECTION", F.col("_offset").isNotNull()).drop("_key")
    floor = F.lit(0.0)
    for program, value in (floors or FLOORS).items():
        floor = F.when(label("PROGRAM") == program.upper(), F.lit(float(value))).otherwise(floor)
    adopted = matched.withColumns({"IS_MAIN_BACKUP": backup, "VRAD_OFFSET": F.when(backup, F.coalesce("_offset", F.lit(0.0))).otherwise(F.lit(0.0)), "VRAD_FLOOR": floor})
    return adopted.withColumns({"VRAD_ADOPTED": F.col("VRAD") - F.col("VRAD_OFFSET"), "VRAD_ERR_ADOPTED": F.hypot("VRAD_ERR", "VRAD_FLOOR")}).drop("_offset")


def correction_coverage(adopted: DataFrame) -> DataFrame:
    """One row: main backup epochs, those with and without a correction, and other epochs with one."""
    backup, match = F.col("IS_MAIN_BACKUP"), F.col("HAS_CORRECTION")
    return adopted.agg(
        F.count_if(backup).alias("N_BACKUP_EPOCHS"),
        F.count_if(backup & match).alias("N_BACKUP_EPOCHS_MATCHED"),
        F.count_if(backup & ~match).alias("N_BACKUP_EPOCHS_UNMATCHED"),
        F.count_if(~backup & match).alias("N_NON_BACKUP_TARGETID_MATCHES"),
    )
