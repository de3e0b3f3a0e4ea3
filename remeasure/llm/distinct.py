"""Problem 3: exact distinct counts over huge identifier sets from mergeable bitmaps.

Method: identifiers are encoded as dense integers by a dictionary. Each day and group has a
bitmap of them, cut into buckets of 64 identifiers; a bucket without an identifier isn't stored,
which compresses the bitmap. Bitmaps are merged by OR (unions) or AND (overlaps) of the buckets
they share, and a count is the number of bits. The error is zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_label, clean_night
from remeasure.session import stored

#: Identifiers that are numbered in one task.
PART = 1_000_000


def dictionary(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, code): dense codes from 0 for the distinct ids of ``sightings`` (columns id and day).

    With ``known``, an earlier dictionary, its codes stay as they are and ids that it lacks get the
    next ones, so that bitmaps made with it remain valid: those of later loads are merged with them
    by ``merged``. The result holds both.

    New codes follow the day an id is first seen, so that one day's ids share buckets. A day is
    numbered in parts of about PART ids; only the sizes of the parts, one row for each day and PART
    ids, are summed up in one task.
    """
    first = sightings.where("id is not null").groupBy("id").agg(F.min("day").alias("day"))
    start = 0
    if known is not None:
        highest = known.agg(F.max("code")).first()[0]
        start = 0 if highest is None else highest + 1
        first = first.join(known.select("id"), "id", "left_anti")
    first = stored(first)
    days = stored(first.groupBy("day").agg(F.expr(f"count(*) div {PART} + 1").alias("parts")))
    marked = first.alias("f").join(days.alias("d"), F.col("f.day").eqNullSafe(F.col("d.day"))).select("f.*", F.pmod(F.xxhash64("f.id"), F.col("d.parts")).alias("part"))
    sizes = marked.groupBy("day", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("day").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("day", "part", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("day", "part").orderBy("id")) - 1
    numbered = marked.withColumn("place", place).alias("n")
    here = F.col("n.day").eqNullSafe(F.col("s.day")) & (F.col("n.part") == F.col("s.part"))
    fresh = numbered.join(starts.alias("s"), here).select("n.id", (F.col("place") + F.col("start") + start).alias("code"))
    return fresh if known is None else known.select("id", "code").unionByName(fresh)


def bitmaps(sightings: DataFrame, codes: DataFrame) -> DataFrame:
    """(day, group, bucket, bits): the stored partial result of every day and group.

    bits has bit k set if the identifier with code 64 * bucket + k was seen. Partial results of
    separate loads whose dictionaries grew from one another are merged by ``merged``.
    """
    seen = sightings.where("id is not null").select("day", "group", "id").distinct().join(codes, "id")
    bit = F.expr("shiftleft(1L, cast(code % 64 as int))")
    return seen.groupBy("day", "group", F.expr("code div 64").alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def merged(maps: DataFrame, *by: Column | str) -> DataFrame:
    """The bitmaps of the unions named by ``by``: OR of all buckets they share."""
    return maps.groupBy(*by, "bucket").agg(F.bit_or("bits").alias("bits"))


def overlap(maps: DataFrame, column: str, names: list[str], *by: str) -> DataFrame:
    """The bitmaps of what all of ``names`` have in common, any number of values of ``column``: AND of the buckets that none of them lacks."""
    own = merged(maps.where(F.col(column).isin(names)), *by, column)
    shared = own.groupBy(*by, "bucket").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
    return shared.where(F.col("n") == len(set(names))).drop("n")


def counted(maps: DataFrame, *by: str) -> DataFrame:
    """n_distinct of each bitmap."""
    return maps.groupBy(*by).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n_distinct"))


def distinct_report(sightings: DataFrame, field: str) -> DataFrame:
    """Distinct ids of ``sightings`` (id, day as yyyymmdd, group) for days, groups and their unions.

    Columns field_name, scope, night, program, n_distinct, max_error (0: the counts are exact).
    Scopes: 'night_program', 'night', 'program', 'month' and 'month_program' (unions of nights,
    night holds yyyymm), 'all', and for two programs 'programs_or' and 'programs_and'
    (program holds 'A | B' or 'A & B'). Null ids count nowhere; a null day or group is a day or
    group of its own, except in pairs of programs. Repeated rows change nothing.
    """
    seen = stored(sightings.where("id is not null").select("id", F.col("day").cast("string").alias("day"), "group").distinct())
    maps = stored(bitmaps(seen, dictionary(seen)))
    month = F.substring("day", 1, 6).alias("month")
    by_program = stored(merged(maps, "group"))

    def rows(df: DataFrame, scope: str, night: Column, program: Column) -> DataFrame:
        return df.select(F.lit(field).alias("field_name"), F.lit(scope).alias("scope"), night.cast("string").alias("night"), program.cast("string").alias("program"), "n_distinct", F.lit(0).alias("max_error"))

    none = F.lit(None)
    left = by_program.where(F.col("group").isNotNull()).select("bucket", F.col("group").alias("a"), F.col("bits").alias("bits_a"))
    right = left.select("bucket", F.col("a").alias("b"), F.col("bits_a").alias("bits_b"))
    # buckets that two programs share; at most one row for each program and bucket on either side
    shared = left.join(right, "bucket").where("a < b")
    overlap = shared.groupBy("a", "b").agg(F.sum(F.bit_count(F.expr("bits_a & bits_b"))).cast("bigint").alias("both"))
    single = counted(by_program.where(F.col("group").isNotNull()), "group")
    one = single.select(F.col("group").alias("a"), F.col("n_distinct").alias("n_a"))
    other = single.select(F.col("group").alias("b"), F.col("n_distinct").alias("n_b"))
    # |A or B| = |A| + |B| - |A and B|, so only shared buckets have to meet; the report has a row for
    # every two programs, one row each meets here
    pairs = one.join(other, F.col("a") < F.col("b")).join(overlap, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    either = pairs.withColumn("n_distinct", F.col("n_a") + F.col("n_b") - F.col("both"))
    return reduce(
        DataFrame.unionByName,
        [
            rows(counted(maps, "day", "group"), "night_program", F.col("day"), F.col("group")),
            rows(counted(merged(maps, "day"), "day"), "night", F.col("day"), none),
            rows(counted(by_program, "group"), "program", none, F.col("group")),
            rows(counted(merged(maps, month), "month"), "month", F.col("month"), none),
            rows(counted(merged(maps, month, "group"), "month", "group"), "month_program", F.col("month"), F.col("group")),
            rows(counted(merged(by_program)), "all", none, none).where("n_distinct is not null"),
            rows(either, "programs_or", none, F.concat_ws(" | ", "a", "b")),
            rows(pairs.select("a", "b", F.col("both").alias("n_distinct")), "programs_and", none, F.concat_ws(" & ", "a", "b")),
        ],
    )


def combination_report(sightings: DataFrame, field: str, names: list[str]) -> DataFrame:
    """(field_name, combination, n_distinct): distinct ids of the groups ``names`` together ('any') and in all of them ('every'), night by night merged."""
    seen = stored(sightings.where("id is not null").select("id", F.col("day").cast("string").alias("day"), "group").distinct())
    by_group = stored(merged(bitmaps(seen, dictionary(seen)), "group"))
    rows = [("any", counted(merged(by_group.where(F.col("group").isin(names))))), ("every", counted(overlap(by_group, "group", names)))]
    return reduce(DataFrame.unionByName, [df.select(F.lit(field).alias("field_name"), F.lit(name).alias("combination"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")) for name, df in rows])


def measurement_sightings(rvtab: DataFrame) -> DataFrame:
    return rvtab.select(F.col("targetid").alias("id"), F.col("night").cast("string").alias("day"), clean_label(F.col("program")).alias("group"))


def pair_sightings(pairs: DataFrame) -> DataFrame:
    """Both ends of every pair: its group was seen on either night in either program."""
    ends = [
        pairs.select(F.col("group_id").alias("id"), clean_night(F.col(f"night_{k}")).alias("day"), clean_label(F.col(f"program_{k}")).alias("group"))
        for k in (1, 2)
    ]
    return ends[0].unionByName(ends[1])
