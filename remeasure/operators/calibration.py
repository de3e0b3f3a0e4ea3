"""Robust summaries of pair residuals, overall and by stratum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import is_finite
from remeasure.functions.ranks import grouped_quantiles, same
from remeasure.operators.summary import MAD_TO_SIGMA
from remeasure.session import stored

INTERDAY_DAYS = 1.0
SN_BINS, LEAST_FOR_BINS = 6, 10


def residual_tables(pairs: DataFrame, tables: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """Summaries of several sets of residuals, made together: tables is {name: (rows to take, group, z column)}.

    Columns TABLE, GROUP, N_PAIRS, MEDIAN_Z, ROBUST_WIDTH_Z, MAD_WIDTH_Z, Q16_Z, Q84_Z, TAIL_GT_3, TAIL_GT_5 and
    Z_COLUMN. Each pair is written once for each table that takes it, as three narrow columns; two rounds
    of quantiles serve all tables. A null group is a group; groups without finite residuals have no row.
    """
    each = [F.when(take & is_finite(F.col(z)), F.struct(F.lit(name).alias("TABLE"), group.cast("string").alias("GROUP"), F.col(z).cast("double").alias("z"))) for name, (take, group, z) in tables.items()]
    rows = stored(pairs.select(F.inline(F.array_compact(F.array(*each)))))
    keys = ["TABLE", "GROUP"]
    quantiles = grouped_quantiles(rows, keys, "z", {"Q16_Z": 0.16, "MEDIAN_Z": 0.5, "Q84_Z": 0.84}, kept=True)
    tail = lambda k: F.avg((F.abs("z") > k).cast("int")).alias(f"TAIL_GT_{k}")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("N_PAIRS"), tail(3), tail(5))
    # a row for each group: stored, so that its size is known before the rows meet it
    usual = stored(counts.alias("c").join(quantiles.alias("q"), same("c", "q", keys)).select("c.*", "q.Q16_Z", "q.MEDIAN_Z", "q.Q84_Z"))
    away = rows.alias("r").join(usual.alias("q"), same("r", "q", keys)).select(*[F.col(f"r.{k}").alias(k) for k in keys], F.abs(F.col("r.z") - F.col("q.MEDIAN_Z")).alias("d"))
    mad = grouped_quantiles(away, keys, "d", {"mad": 0.5})
    names = F.create_map(*[F.lit(x) for name, (_, _, z) in tables.items() for x in (name, z)])
    width = (F.col("u.Q84_Z") - F.col("u.Q16_Z")) / 2
    return usual.alias("u").join(mad.alias("m"), same("u", "m", keys)).select(
        "u.TABLE", "u.GROUP", "u.N_PAIRS", "u.MEDIAN_Z", width.alias("ROBUST_WIDTH_Z"), (MAD_TO_SIGMA * F.col("m.mad")).alias("MAD_WIDTH_Z"),
        "u.Q16_Z", "u.Q84_Z", "u.TAIL_GT_3", "u.TAIL_GT_5", F.element_at(names, F.col("u.TABLE")).alias("Z_COLUMN"),
    )


def summarize_pair_residuals(pairs: DataFrame, group_by: str | None = None, z_column: str = "PAIR_Z") -> DataFrame:
    """One table of ``residual_tables``, its group named like ``group_by``. Without it the one group is called all."""
    name = group_by or "GROUP"
    group = F.col(group_by) if group_by else F.lit("all")
    return residual_tables(pairs, {"one": (F.lit(True), group, z_column)}).drop("TABLE").withColumnRenamed("GROUP", name)


def interday(pairs: DataFrame, days: float = INTERDAY_DAYS) -> DataFrame:
    return pairs.where(F.col("DELTA_DAYS") > days)


def add_quantile_bin(df: DataFrame, column: str, bins: int = SN_BINS, name: str | None = None) -> DataFrame:
    """``df`` with a label (lo, hi] of the quantile bin; the lowest value belongs to the first bin.

    Equal edges are merged; without two different edges every finite value is in 'all'. Nulls have
    no bin. Only the ``bins`` + 1 edges come to the driver.
    """
    name = name or f"{column}_BIN"
    at = {f"q{k}": k / bins for k in range(bins + 1)}
    row = grouped_quantiles(df.select(F.lit(0).alias("_g"), column), ["_g"], column, at).first()
    edges = sorted({row[k] for k in at}) if row else []
    value = F.col(column)
    if len(edges) < 2:
        return df.withColumn(name, F.when(is_finite(value), "all"))
    label: Column = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        shown = f"({low:.3f}, {high:.3f}]"
        label = F.when(value <= high, F.lit(shown)).otherwise(label)
    return df.withColumn(name, F.when(is_finite(value) & (value >= edges[0]), label))


#: Tables of a run: (whether only pairs more than a day apart count, group, z column).
_TABLES = {
    "calibration_overall": (False, None, "PAIR_Z"),
    "calibration_overall_formal": (False, None, "PAIR_Z_FORMAL"),
    "calibration_by_program": (False, "PROGRAM_PAIR", "PROGRAM_PAIR_Z"),
    "calibration_by_program_formal": (False, "PROGRAM_PAIR", "PROGRAM_PAIR_Z_FORMAL"),
    "calibration_interday": (True, "PROGRAM_PAIR", "PROGRAM_PAIR_Z"),
    "calibration_interday_formal": (True, "PROGRAM_PAIR", "PROGRAM_PAIR_Z_FORMAL"),
}


def all_tables(pairs: DataFrame) -> DataFrame:
    """The seven tables of a run in one (see ``residual_tables``), from one reading of ``pairs``.

    The one by signal-to-noise needs at least LEAST_FOR_BINS values.
    """
    later = F.coalesce(F.col("DELTA_DAYS") > INTERDAY_DAYS, F.lit(False))
    wanted = {name: (later if apart else F.lit(True), F.col(group) if group else F.lit("all"), z) for name, (apart, group, z) in _TABLES.items()}
    if pairs.where(F.col("SN_R_MIN").isNotNull()).limit(LEAST_FOR_BINS).count() == LEAST_FOR_BINS:
        pairs = add_quantile_bin(pairs, "SN_R_MIN")
        wanted["calibration_by_sn"] = (F.lit(True), F.col("SN_R_MIN_BIN"), "PAIR_Z")
    return residual_tables(pairs, wanted)


def calibration_tables(pairs: DataFrame) -> dict[str, DataFrame]:
    """The seven tables of a run by name, each with its group column under its own name."""
    every = stored(all_tables(pairs))
    names = [r[0] for r in every.select("TABLE").distinct().collect()]
    groups = {name: group or "GROUP" for name, (_, group, _) in _TABLES.items()} | {"calibration_by_sn": "SN_R_MIN_BIN"}
    wanted = [n for n in groups if n in names or n in _TABLES]
    return {n: every.where(F.col("TABLE") == n).drop("TABLE").withColumnRenamed("GROUP", groups[n]) for n in wanted}


def residual_histogram(pairs: DataFrame, columns: tuple[str, ...] = ("PAIR_Z_FORMAL", "PAIR_Z"), low: float = -8.0, high: float = 8.0, bins: int = 128) -> DataFrame:
    """(Z_COLUMN, BIN, BIN_LOW, N, DENSITY) of equal bins; the last one holds its upper edge, values beyond count nowhere."""
    width = (high - low) / bins
    rows = reduce(DataFrame.unionByName, [pairs.select(F.lit(c).alias("Z_COLUMN"), F.col(c).alias("z")) for c in columns])
    inside = rows.where((F.col("z") >= low) & (F.col("z") <= high))
    counts = inside.groupBy("Z_COLUMN", F.least(F.floor((F.col("z") - low) / width), F.lit(bins - 1)).alias("BIN")).agg(F.count("*").alias("N"))
    totals = counts.groupBy("Z_COLUMN").agg(F.sum("N").alias("total"))
    return counts.join(totals, "Z_COLUMN").select("Z_COLUMN", "BIN", (F.col("BIN") * width + low).alias("BIN_LOW"), "N", (F.col("N") / (F.col("total") * width)).alias("DENSITY"))


def program_pair_counts(pairs: DataFrame, program: str = "BACKUP") -> DataFrame:
    """One row: pairs that involve ``program``, and those of them with another program."""
    parts = F.split("PROGRAM_PAIR", " / ")
    with_it = F.array_contains(parts, program)
    cross = with_it & F.exists(parts, lambda x: x != program)
    return pairs.agg(F.count_if(with_it).alias("N_PAIRS_WITH_PROGRAM"), F.count_if(cross).alias("N_CROSS_PROGRAM_PAIRS"))


def headline(pairs: DataFrame) -> DataFrame:
    """One row: median, half-width and tail beyond 5 of the non-null PAIR_Z."""
    return summarize_pair_residuals(pairs).select("N_PAIRS", "MEDIAN_Z", "ROBUST_WIDTH_Z", "TAIL_GT_5")
