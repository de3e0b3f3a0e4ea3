"""Zero points of one dimension at a time (program, night, tile, exposure or fiber), all dimensions in the same jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import is_finite
from remeasure.functions.ranks import column_quantiles, grouped_quantiles, same
from remeasure.operators.label_offsets import OffsetRules, hashed, pair_sums, solved_offsets
from remeasure.session import stored

PARTS = ("summary", "by_program", "offsets")
DIMENSIONS = ("PROGRAM", "NIGHT", "TILEID", "EXPID", "FIBER")
ZERO_POINT_RULES = OffsetRules(min_delta_days=1.0, min_pairs_per_label=200, max_abs_z=5.0, damp=0.05, balance_groups=False, center_components=False)


def base_pairs(pairs: DataFrame, dimensions: list[str], min_days: float | None = 1.0) -> DataFrame:
    """(GROUP_ID, PROGRAM_PAIR, d, err, z, and the labels of both ends in each of ``dimensions``) of pairs with finite values and an error above 0."""
    label = lambda dimension, k: F.coalesce(F.trim(F.col(f"{dimension}_{k}").cast("string")), F.lit(""))
    d, err = F.col("DELTA_VRAD"), F.col("PAIR_ERROR")
    usable = is_finite(d) & is_finite(err) & (err > 0)
    if min_days is not None and "DELTA_DAYS" in pairs.columns:
        usable &= F.col("DELTA_DAYS") > min_days
    stratum = F.col("PROGRAM_PAIR") if "PROGRAM_PAIR" in pairs.columns else F.lit(None).cast("string")
    ends = [label(name, k).alias(f"{name}_{k}") for name in dimensions for k in (1, 2)]
    return pairs.where(usable).select("GROUP_ID", stratum.alias("PROGRAM_PAIR"), d.alias("d"), err.alias("err"), F.col("PAIR_Z").alias("z"), *ends)


def by_dimension(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """A row of ``base_pairs`` for each of ``dimensions`` that labels both its ends: run, L1 and L2 instead of the labels."""
    labels = F.array(*[F.struct(F.lit(name).alias("run"), F.col(f"{name}_1").alias("L1"), F.col(f"{name}_2").alias("L2")) for name in dimensions])
    others = [c for c in rows.columns if c not in {f"{name}_{k}" for name in dimensions for k in (1, 2)}]
    return rows.select(*others, F.inline(labels)).where("L1 <> '' and L2 <> ''")


def _z_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, quantiles and tails of the finite z before and after, side by side; a side without finite values has 0 pairs and nulls."""
    sides = ("before", "after")
    finite = [F.when(is_finite(F.col(f"z_{s}")), F.col(f"z_{s}")).alias(f"z_{s}") for s in sides]
    rows = scored.select(*keys, *finite)
    tail = lambda s, k: F.avg((F.abs(f"z_{s}") > k).cast("int")).alias(f"tail_{k}_{s}")
    counts = rows.groupBy(*keys).agg(*[c for s in sides for c in (F.count(f"z_{s}").alias(f"n_{s}"), tail(s, 3), tail(s, 5))])
    quantiles = column_quantiles(rows, keys, {f"z_{s}": {f"lo_{s}": 0.16, f"median_z_{s}": 0.5, f"hi_{s}": 0.84} for s in sides}, kept=True)
    both = counts.alias("c").join(quantiles.alias("q"), same("c", "q", keys), "left")
    return both.select("c.*", *[c for s in sides for c in (F.col(f"q.median_z_{s}"), ((F.col(f"q.hi_{s}") - F.col(f"q.lo_{s}")) / 2).alias(f"width_z_{s}"))])


def zero_point_calibration(pairs: DataFrame, dimensions: list[str] | None = None, rules: OffsetRules = ZERO_POINT_RULES, train_fraction: float = 0.5, interday_only: bool = True, parts: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """{'summary', 'by_program', 'offsets'}, or those of them in ``parts``, of every known dimension; unknown ones, and those without columns, are left out.

    Sources are split by hash, null ones together. Training pairs beyond ``max_abs_z`` leave first;
    labels are then counted over both ends of what is left, and those with enough ends are kept,
    whether or not an equation holds them: without one their offset is 0 before the median of all
    kept labels is taken off. Held-out pairs are scored with 0 for labels that aren't kept. A
    dimension with fewer than two kept labels, or no equation, has equal metrics before and after
    and no rows in the other tables; one without usable pairs has zeros and nulls.
    """
    known = [d for d in dict.fromkeys(d.upper() for d in dimensions or DIMENSIONS) if d in DIMENSIONS and f"{d}_1" in pairs.columns]
    spark = pairs.sparkSession
    days = rules.min_delta_days if interday_only else None
    schema = "dimension string"
    if not known:
        empty = spark.createDataFrame([], schema)
        return {part: empty for part in parts}
    rows = base_pairs(pairs, known, days)
    split = hashed(F.coalesce(F.col("GROUP_ID").cast("string"), F.lit("")), 1000) < train_fraction * 1000
    # a pair is written once, with its labels in all dimensions, and multiplied where it is read
    rows = by_dimension(stored(rows.withColumn("in_train", split)), known)
    train = rows.where("in_train").where(F.abs("z") <= rules.max_abs_z)
    ends = train.select("run", F.explode(F.array("L1", "L2")).alias("label")).groupBy("run", "label").agg(F.count("*").alias("n_endpoints"))
    labels = stored(ends.where(F.col("n_endpoints") >= rules.min_pairs_per_label))
    kept = train.where("L1 <> L2")
    for end in ("L1", "L2"):
        kept = kept.join(labels.select("run", F.col("label").alias(end)), ["run", end], "left_semi")
    yes = F.array(F.lit(True))
    sums = stored(pair_sums(kept.withColumns({"use": yes, "kept": yes}), 1, rules.balance_groups))
    counted = sums.groupBy("run").agg(F.sum("n").alias("n_train_pairs")).where("n_train_pairs > 0")
    found = labels.join(counted.select("run"), "run", "left_semi").join(solved_offsets(sums, rules).select("run", "label", "offset"), ["run", "label"], "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))
    found = stored(found)
    middle = grouped_quantiles(found, ["run"], "offset", {"middle": 0.5}, kept=True)
    offsets = stored(found.join(middle, "run").select("run", "label", (F.col("offset") - F.col("middle")).alias("offset"), "n_endpoints"))
    out = {"offsets": offsets}
    if set(parts) == {"offsets"}:
        return {name: df.withColumnRenamed("run", "dimension") for name, df in out.items()}
    scored = rows.where("not in_train")
    for k in (1, 2):
        scored = scored.join(offsets.select("run", F.col("label").alias(f"L{k}"), F.col("offset").alias(f"o{k}")), ["run", f"L{k}"], "left")
    change = F.coalesce("o1", F.lit(0.0)) - F.coalesce("o2", F.lit(0.0))
    fitted = stored(offsets.select("run").distinct().withColumn("fitted", F.lit(True)))
    after = F.when(F.col("fitted"), (F.col("d") - change) / F.col("err")).otherwise(F.col("z"))
    scored = stored(scored.join(fitted, "run", "left").select("run", "PROGRAM_PAIR", "fitted", F.col("z").alias("z_before"), after.alias("z_after")))
    if "by_program" in parts:
        out["by_program"] = _z_metrics(scored.where("fitted"), ["run", "PROGRAM_PAIR"])
    if "summary" in parts:
        every = spark.createDataFrame([(d,) for d in known], "run string")
        n_labels = labels.groupBy("run").agg(F.count("*").alias("n_labels"))
        # without a fit all held-out pairs count, with one those that have a finite z
        held = scored.groupBy("run").agg(F.when(F.max("fitted"), F.count_if(is_finite(F.col("z_before")))).otherwise(F.count("*")).alias("n_holdout_pairs"))
        largest = offsets.groupBy("run").agg(F.max(F.abs("offset")).alias("max_abs_offset"))
        summary = every
        for part in (n_labels, counted, held, largest, _z_metrics(scored, ["run"]).drop("n_before", "n_after")):
            summary = summary.join(part, "run", "left")
        summary = summary.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_labels", "n_train_pairs", "n_holdout_pairs")})
        change_of = {f"delta_{c}": F.col(f"{c}_after") - F.col(f"{c}_before") for c in ("width_z", "tail_5")}
        out["summary"] = summary.withColumns(change_of)
    return {name: out[name].withColumnRenamed("run", "dimension") for name in parts}


def estimate_zero_points(pairs: DataFrame, dimension: str, rules: OffsetRules = ZERO_POINT_RULES, train_fraction: float = 0.5, interday_only: bool = True) -> dict[str, DataFrame]:
    """``zero_point_calibration`` of one dimension; ValueError for an unknown one."""
    if dimension.upper() not in DIMENSIONS:
        raise ValueError(f"Unknown dimension: {dimension}")
    return zero_point_calibration(pairs, [dimension], rules, train_fraction, interday_only)
