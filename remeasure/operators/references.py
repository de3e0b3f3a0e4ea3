"""Problem 4: references to records that don't exist, or not yet, or no longer.

Method: parent and child keys are united in long form, tagged, and grouped by parent table,
key and day; groups carry over the latest end of force of their parents, and a child whose
group has no parent in force at its time is an orphan. Orphans are counted by period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_label

#: Later than any time in the data: the end of force of rows that are never deleted.
_FOREVER = "9999-12-31 00:00:00"
_HERE = ["ref_table", "key", "day"]


def observations(rvtab: DataFrame) -> DataFrame:
    """Each observation once, as of its earliest ingested_at (null times last; ties by the other columns).

    Observations with a null obs_id can't be told apart and are left out.
    """
    columns = ["ingested_at", "targetid", "survey", "program", "night", "tileid"]
    late = F.col("ingested_at").isNull()
    first = rvtab.where("obs_id is not null").groupBy("obs_id").agg(F.min(F.struct(late.alias("late"), *columns)).alias("f"))
    first = first.select("obs_id", *[F.col(f"f.{c}").alias(c) for c in columns])
    backup = (clean_label(F.col("survey")) == "MAIN") & (clean_label(F.col("program")) == "BACKUP")
    return first.withColumn("is_main_backup", F.coalesce(backup, F.lit(False))).drop("survey", "program")


def _parents(df: DataFrame, name: str) -> DataFrame:
    until = F.coalesce(F.col("deleted_at"), F.lit(_FOREVER).cast("timestamp_ntz"))
    rows = df.where("targetid is not null and loaded_at is not null")
    return rows.select(F.lit(name).alias("ref_table"), F.col("targetid").alias("key"), F.col("loaded_at").alias("at"), until.alias("until"), F.lit(None).cast("bigint").alias("obs_id"))


def _children(obs: DataFrame, name: str) -> DataFrame:
    return obs.select(F.lit(name).alias("ref_table"), F.col("targetid").alias("key"), F.col("ingested_at").alias("at"), F.lit(None).cast("timestamp_ntz").alias("until"), "obs_id")


def references(obs: DataFrame, gaia: DataFrame, backup_correction: DataFrame) -> DataFrame:
    """(ref_table, obs_id, known, in_force) for every reference that an observation makes.

    A non-null targetid refers to gaia, that of a main-survey backup epoch also to
    backup_correction. known: some row has the key at all; in_force: one with loaded_at <= time
    < deleted_at. An observation without a time has nothing in force. Parent rows without a key
    or loaded_at never apply; repeated parents change nothing.

    All of it is grouped by (table, key, day of the event): a key that holds a large part of all
    rows is spread over days, and what one day leaves to the next is a single row.
    """
    obs = obs.where("targetid is not null")
    tagged = _parents(gaia, "gaia").unionByName(_parents(backup_correction, "backup_correction")).distinct()
    tagged = tagged.unionByName(_children(obs, "gaia")).unionByName(_children(obs.where("is_main_backup"), "backup_correction"))
    tagged = tagged.withColumn("day", F.to_date("at"))
    latest = tagged.groupBy(*_HERE).agg(F.max("until").alias("until"))
    over_days = Window.partitionBy("ref_table", "key")
    before = over_days.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(*_HERE, F.max("until").over(before).alias("carried"), F.max("until").over(over_days).isNotNull().alias("known"))
    # what earlier days leave comes in as one more row at the start of the day
    lines = tagged.select(*_HERE, "at", "until", "obs_id", F.lit(None).cast("boolean").alias("known"))
    starts = carried.select(*_HERE, F.to_timestamp_ntz("day").alias("at"), F.col("carried").alias("until"), F.lit(None).cast("bigint").alias("obs_id"), "known")
    lines = lines.unionByName(starts)
    day = Window.partitionBy(*_HERE)
    so_far = day.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    judged = lines.select("ref_table", "obs_id", "at", F.max("until").over(so_far).alias("until"), F.max("known").over(so_far).alias("known")).where("obs_id is not null")
    in_force = F.coalesce(F.col("until") > F.col("at"), F.lit(False))
    return judged.select("ref_table", "obs_id", F.coalesce("known", F.lit(False)).alias("known"), in_force.alias("in_force"))


def orphans(rvtab: DataFrame, gaia: DataFrame, backup_correction: DataFrame) -> DataFrame:
    """(ref_table, obs_id) of each reference whose target wasn't in force."""
    return references(observations(rvtab), gaia, backup_correction).where("not in_force").select("ref_table", "obs_id")


def orphans_by_night(rvtab: DataFrame, gaia: DataFrame, backup_correction: DataFrame) -> DataFrame:
    """(ref_table, night, n_references, n_orphans, n_unknown); n_unknown counts keys that no row of the table has."""
    obs = observations(rvtab)
    found = references(obs, gaia, backup_correction).join(obs.select("obs_id", "night"), "obs_id")
    count = lambda c: F.count_if(c).alias
    return found.groupBy("ref_table", "night").agg(F.count("*").alias("n_references"), count(~F.col("in_force"))("n_orphans"), count(~F.col("known"))("n_unknown"))


def coverage_by_tile(rvtab: DataFrame, gaia: DataFrame, backup_correction: DataFrame, summary: DataFrame) -> DataFrame:
    """The counts of correction_summary made again, beside those it states.

    Backup epochs of each tile whose key no correction row has, by mere presence; agrees is null
    where the summary states nothing. Tiles that only one side knows have nulls for the other.
    """
    obs = observations(rvtab)
    known = references(obs, gaia, backup_correction).where("ref_table = 'backup_correction' and known").select("obs_id", F.lit(True).alias("known"))
    epochs = obs.where("is_main_backup").select("obs_id", "tileid").join(known, "obs_id", "left")
    made = epochs.groupBy("tileid").agg(F.count("*").alias("n_backup_epochs_found"), F.count_if(F.col("known").isNull()).alias("n_unmatched_found"))
    stated = summary.select("tileid", "run_night", F.col("n_backup_epochs_unmatched").alias("n_unmatched_stated")).distinct()
    both = stated.join(made, "tileid", "full")
    return both.withColumn("agrees", F.col("n_unmatched_found") == F.col("n_unmatched_stated"))
