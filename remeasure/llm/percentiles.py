"""Problem 5: exact medians and other percentiles of very large columns per group.

Method: radix selection. A float is mapped to a 64-bit integer of the same order. Histograms
of its leading digits tell which digit holds a wanted rank; only values with that digit are
looked at in the next round, for the next digit. After four digits of 16 bits, or as soon as one
value alone is left, the value is known, so the error is zero. Histograms are counts: those of separate days, runs or partitions
are added up, which is how percentiles over several days are made here.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from remeasure.functions.columns import clean_night, clean_pair_label, is_finite
from remeasure.session import stored

DIGITS, DIGIT_BITS = 4, 16
PERCENTILES = (0.05, 0.16, 0.5, 0.84, 0.95)
_SIGN = np.int64(-(2**63))


@F.pandas_udf(T.LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """64 bits whose unsigned order is that of the doubles."""
    bits = v.to_numpy(dtype=np.float64).view(np.int64)
    return pd.Series(np.where(bits < 0, ~bits, bits ^ _SIGN))


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(v: pd.Series) -> pd.Series:
    bits = v.to_numpy(dtype=np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _SIGN, ~bits).view(np.float64))


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups..., key, n): how often each finite value occurs, as ordered bits; the mergeable partial result."""
    counts = df.where(is_finite(F.col(value))).groupBy(*groups, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("key", ordered_bits("value")).select(*groups, "key", "n")


def _prefix(digits: int) -> Column:
    """The first digits of key."""
    return F.shiftrightunsigned("key", 64 - DIGIT_BITS * digits) if digits else F.lit(0).cast("bigint")


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def radix_percentiles(counts: DataFrame, by: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(by..., percentile, value, n_values): linearly interpolated percentiles of every group of ``counts``.

    ``counts`` has the columns of ``value_counts``; counts of several loads may simply be united.
    A group is named by ``by`` (nulls are a group), one without rows has no result, and ties are
    plain counts. A histogram has at most 65,536 rows for each group and prefix, so no group,
    however large, is gathered in one task.
    """
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("n_values"))
    wanted = sizes.withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    at = F.col("percentile") * (F.col("n_values") - 1)
    wanted = stored(wanted.withColumn("low", F.floor(at)).withColumn("part", at - F.floor(at)))
    ranks = F.explode(F.array_distinct(F.array("low", F.least(F.col("low") + 1, F.col("n_values") - 1))))
    targets = wanted.select(*by, ranks.alias("rank")).distinct()
    targets = targets.withColumn("rest", F.col("rank")).withColumn("prefix", F.lit(0).cast("bigint"))
    names, live, done = [*by, "prefix"], counts, []
    for digit in range(DIGITS):
        live = live.withColumn("prefix", _prefix(digit))
        if digit:
            # both sides grow with the groups: a merge join, which shuffles them by group and prefix
            held = targets.select(*names).distinct().hint("merge")
            live = stored(live.alias("l").join(held.alias("h"), _same("l", "h", names), "left_semi"))
        shift = 64 - DIGIT_BITS * (digit + 1)
        here = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).alias("digit")
        histogram = live.groupBy(*names, here).agg(F.sum("n").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        upper = F.sum("n").over(Window.partitionBy(*names).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        histogram = histogram.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("n"))
        inside = _same("t", "h", names) & (F.col("t.rest") >= F.col("h.lower")) & (F.col("t.rest") < F.col("h.upper"))
        found = targets.alias("t").join(histogram.hint("merge").alias("h"), inside)
        longer = F.shiftleft("t.prefix", DIGIT_BITS).bitwiseOR(F.col("h.digit"))
        # a digit that one value alone has gives it away; the next rounds look at the others
        known = F.when(F.col("h.least") == F.col("h.most"), F.col("h.least")).alias("known")
        found = stored(found.select(*[f"t.{c}" for c in by], "t.rank", (F.col("t.rest") - F.col("h.lower")).alias("rest"), longer.alias("prefix"), known))
        done.append(found.where("known is not null").select(*by, "rank", "known"))
        targets = found.where("known is null").drop("known")
        if targets.isEmpty():
            break
    values = reduce(DataFrame.unionByName, done).withColumn("at_rank", from_ordered_bits("known"))
    low = wanted.alias("w").join(values.hint("merge").alias("v"), _same("w", "v", by) & (F.col("w.low") == F.col("v.rank")))
    low = low.select("w.*", F.col("v.at_rank").alias("low_value"))
    high = F.least(F.col("w.low") + 1, F.col("w.n_values") - 1)
    both = low.alias("w").join(values.hint("merge").alias("v"), _same("w", "v", by) & (high == F.col("v.rank")))
    value = F.col("w.low_value") + F.col("w.part") * (F.col("v.at_rank") - F.col("w.low_value"))
    return both.select(*[f"w.{c}" for c in by], "w.percentile", value.alias("value"), "w.n_values")


def percentile_report(readings: dict[str, DataFrame], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """Percentiles of each field's readings (program_pair, night, value) for each pair and night, and for each pair over all nights.

    Columns field_name, scope ('night' or 'all'), program_pair, night, percentile, value,
    n_values, max_error (0: the values are exact). Null, NaN and infinite values don't count;
    null pairs and nights are groups of their own. All fields and scopes share the four rounds.
    """
    columns = ["field_name", "program_pair", "night"]
    named = [df.select(F.lit(name).alias("field_name"), "program_pair", "night", "value") for name, df in readings.items()]
    nightly = stored(value_counts(reduce(DataFrame.unionByName, named), columns, "value"))
    overall = nightly.groupBy("field_name", "program_pair", "key").agg(F.sum("n").alias("n")).withColumn("night", F.lit(None).cast("string"))
    counts = stored(nightly.withColumn("scope", F.lit("night")).unionByName(overall.withColumn("scope", F.lit("all"))))
    found = radix_percentiles(counts, ["field_name", "scope", "program_pair", "night"], percentiles)
    return found.withColumn("max_error", F.lit(0.0))


def _named(rows: DataFrame, night: Column) -> DataFrame:
    """``rows`` with clean names for their spellings of program_pair and night, each spelling cleaned once."""
    spelled = stored(rows.select("program_pair", "night").distinct().withColumns({"clean_pair": clean_pair_label(F.col("program_pair")), "clean_night": night}))
    joined = rows.alias("r").join(spelled.alias("s"), _same("r", "s", ["program_pair", "night"]))
    others = [F.col(f"r.{c}") for c in rows.columns if c not in ("program_pair", "night")]
    return joined.select(*others, F.col("s.clean_pair").alias("program_pair"), F.col("s.clean_night").alias("night"))


def pair_readings(pairs: DataFrame) -> DataFrame:
    """delta_vrad by program pair and first night; a pair delivered again counts once."""
    rows = pairs.select("pair_id", "program_pair", F.col("night_1").cast("string").alias("night"), F.col("delta_vrad").alias("value"))
    return _named(rows, clean_night(F.col("night"))).distinct()


def run_readings(by_program: DataFrame) -> DataFrame:
    """raw_width_before_kms by program pair and night of the run; the same row counts once."""
    rows = by_program.select("run_id", "fold", "program_pair", F.col("run_night").cast("string").alias("night"), F.col("raw_width_before_kms").alias("value"))
    return _named(rows, F.col("night")).distinct()
