"""Pairs of epochs of the same source, evenly spaced over all its pairs up to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_or_unknown
from remeasure.functions.ranks import numbered
from remeasure.operators.summary import error_column, value_column
from remeasure.session import stored

DEFAULT_CAP = 50
#: Columns of the pair table that each end brings in, as (name, source column).
_ENDS = ("TARGETID", "SOURCE_ID", "EXPID", "MJD", "FIBER", "NIGHT", "TILEID")
# The columns of the pair table.
PAIR_COLUMNS = (
    "GROUP_ID", "GROUP_KIND", "TARGETID_1", "TARGETID_2", "SOURCE_ID_1", "SOURCE_ID_2", "OBS_KEY_1", "OBS_KEY_2", "EXPOSURE_KEY_1", "EXPOSURE_KEY_2",
    "EXPID_1", "EXPID_2", "MJD_1", "MJD_2", "DELTA_DAYS", "VRAD_1", "VRAD_2", "DELTA_VRAD", "PAIR_ERROR", "PAIR_Z", "VRAD_FORMAL_1", "VRAD_FORMAL_2",
    "DELTA_VRAD_FORMAL", "PAIR_ERROR_FORMAL", "PAIR_Z_FORMAL", "SN_R_MIN", "PROGRAM_1", "PROGRAM_2", "PROGRAM_PAIR", "PROGRAM_DELTA_VRAD", "PROGRAM_PAIR_Z",
    "PROGRAM_DELTA_VRAD_FORMAL", "PROGRAM_PAIR_Z_FORMAL", "SURVEY_1", "SURVEY_2", "FIBER_1", "FIBER_2", "NIGHT_1", "NIGHT_2", "TILEID_1", "TILEID_2",
    "TEFF_MEDIAN", "LOGG_MEDIAN", "FEH_MEDIAN",
)


def _text(c: Column, default: str) -> Column:
    value = F.trim(c.cast("string"))
    return F.when(value.isNull() | value.isin("", "nan", "<NA>"), F.lit(default)).otherwise(value)


#: Whole numbers beyond a bigint: a group of 5e9 rows has more pairs than that.
_WHOLE = "decimal(38,0)"


def _triangle(n: str) -> Column:
    """n * (n + 1) / 2 as an exact whole number, for a bigint expression ``n``."""
    even = f"pmod({n}, 2) = 0"
    return F.expr(f"cast(cast(if({even}, ({n}) div 2, {n}) as decimal(19,0)) * cast(if({even}, ({n}) + 1, (({n}) + 1) div 2) as decimal(18,0)) as {_WHOLE})")


def _positions(cap: int) -> Column:
    """Evenly spaced places among the _pairs pairs of a group, first and last included, cut to whole numbers."""
    last = F.col("_pairs") - 1
    if cap == 1:
        return F.array(F.lit(0).cast(_WHOLE))
    step = last.cast("double") / F.lit(float(cap - 1))
    # from 2^53 on doubles are whole numbers anyway
    cut = lambda x: F.when(x < float(2**53), F.floor(x).cast(_WHOLE)).otherwise(x.cast(_WHOLE))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.when(k == cap - 1, last.cast(_WHOLE)).otherwise(cut(k * step)))
    every = F.transform(F.sequence(F.lit(0), F.least(last, F.lit(cap)).cast("int")), lambda k: k.cast(_WHOLE))
    return F.when(F.col("_pairs") <= cap, every).otherwise(spaced)


def pair_places(sizes: DataFrame, cap: int) -> DataFrame:
    """(GROUP_ID, pair_no, i, j): the chosen pairs i < j of groups with group_size rows, numbered row by row.

    Pairs are counted from the last one, where the rows are shortest: a square root, good to one
    row for any group size, and a correction in whole numbers give the row.
    """
    wide = sizes.where("group_size > 1").withColumn("_pairs", _triangle("group_size - 1"))
    chosen = wide.withColumn("pair_no", F.explode(_positions(cap))).withColumn("_rest", (F.col("_pairs") - 1 - F.col("pair_no")).cast(_WHOLE))
    guess = chosen.withColumn("_k", F.floor((F.sqrt(8 * F.col("_rest").cast("double") + 1) - 1) / 2))
    row = F.when(_triangle("_k") > F.col("_rest"), F.col("_k") - 1).when(_triangle("_k + 1") <= F.col("_rest"), F.col("_k") + 1).otherwise(F.col("_k"))
    exact = guess.withColumn("_k", row)
    behind = (F.col("_rest") - _triangle("_k")).cast("bigint")
    # never null, and said so: else joins on i and j test the whole arithmetic for nulls, many times over
    place = lambda x: F.coalesce(x, F.lit(-1).cast("bigint"))
    return exact.select("GROUP_ID", "pair_no", place(F.col("group_size") - 2 - F.col("_k")).alias("i"), place(F.col("group_size") - 1 - behind).alias("j"))


def epoch_pairs(epochs: DataFrame, cap: int = DEFAULT_CAP) -> DataFrame:
    """The pair table of the good ``epochs`` (IS_GOOD; all without it), at most ``cap`` pairs a group.

    Epochs are ordered by MJD (nulls last), EXPID and the remaining columns; of n(n-1)/2 pairs the
    evenly spaced ones are made, never more. A cap below 1 gives no rows. Large groups are
    numbered by whole days, so none is sorted in one task.
    """
    if "IS_GOOD" in epochs.columns:
        epochs = epochs.where("IS_GOOD")
    has = set(epochs.columns)
    if "GROUP_ID" not in has:
        epochs = epochs.withColumn("GROUP_ID", F.col("TARGETID"))
    col = lambda c, kind="double": F.col(c) if c in has else F.lit(None).cast(kind)
    survey = clean_or_unknown(col("SURVEY", "string"))
    program = clean_or_unknown(col("PROGRAM", "string"))
    exposure = [survey, program, _text(col("EXPID", "bigint"), "0")]
    source = col("SOURCE_ID", "bigint")
    plain = epochs.select(
        "GROUP_ID", (F.col("GROUP_KIND") if "GROUP_KIND" in has else F.lit("UNKNOWN")).alias("GROUP_KIND"),
        *[F.when(source > 0, source).alias(c) if c == "SOURCE_ID" else col(c, "double" if c == "MJD" else "bigint").alias(c) for c in _ENDS],
        F.concat_ws("|", *exposure, _text(col("FIBER", "bigint"), "0"), _text(F.col("TARGETID"), "0")).alias("OBS_KEY"), F.concat_ws("|", *exposure).alias("EXPOSURE_KEY"),
        F.col(value_column(epochs)).alias("VRAD"), F.col(error_column(epochs)).alias("ERR"), F.col("VRAD").alias("VRAD_FORMAL"), F.col("VRAD_ERR").alias("ERR_FORMAL"),
        col("SN_R").alias("SN_R"), program.alias("PROGRAM"), survey.alias("SURVEY"), *[col(c).alias(c) for c in ("TEFF", "LOGG", "FEH")],
    )
    order = [F.asc_nulls_last("MJD"), F.asc_nulls_last("EXPID"), "OBS_KEY", "VRAD_FORMAL", "ERR_FORMAL", "VRAD"]
    ranked = stored(numbered(stored(plain), ["GROUP_ID"], F.floor("MJD"), order))
    sizes = ranked.where("place = 0").select("GROUP_ID", "group_size")
    places = pair_places(sizes, cap) if cap >= 1 else pair_places(sizes, 1).where(F.lit(False))
    # both sides grow with the groups: merge joins by group and place, on which no key is hot
    a, b = ranked.hint("merge").alias("a"), ranked.hint("merge").alias("b")
    first = places.alias("p").join(a, F.col("p.GROUP_ID").eqNullSafe(F.col("a.GROUP_ID")) & (F.col("p.i") == F.col("a.place")))
    both = first.join(b, F.col("p.GROUP_ID").eqNullSafe(F.col("b.GROUP_ID")) & (F.col("p.j") == F.col("b.place")))
    ends = {f"{c}_{k}": F.col(f"{s}.{c}") for c in (*_ENDS, "OBS_KEY", "EXPOSURE_KEY", "VRAD", "VRAD_FORMAL", "PROGRAM", "SURVEY") for k, s in ((1, "a"), (2, "b"))}
    error = lambda c: F.hypot(F.col(f"a.{c}"), F.col(f"b.{c}"))
    ratio = lambda d, e: F.when(e > 0, d / e)
    delta, formal = F.col("a.VRAD") - F.col("b.VRAD"), F.col("a.VRAD_FORMAL") - F.col("b.VRAD_FORMAL")
    # in the order of the two program names
    turned = F.when(F.col("a.PROGRAM") <= F.col("b.PROGRAM"), 1.0).otherwise(-1.0)
    mean = lambda c: F.coalesce((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2, F.col(f"a.{c}"), F.col(f"b.{c}"))
    made = {
        "GROUP_ID": F.col("a.GROUP_ID"), "GROUP_KIND": F.col("a.GROUP_KIND"), **ends,
        "DELTA_DAYS": F.col("b.MJD") - F.col("a.MJD"), "DELTA_VRAD": delta, "PAIR_ERROR": error("ERR"), "PAIR_Z": ratio(delta, error("ERR")),
        "DELTA_VRAD_FORMAL": formal, "PAIR_ERROR_FORMAL": error("ERR_FORMAL"), "PAIR_Z_FORMAL": ratio(formal, error("ERR_FORMAL")),
        "SN_R_MIN": F.least("a.SN_R", "b.SN_R"), "PROGRAM_PAIR": F.concat_ws(" / ", F.least("a.PROGRAM", "b.PROGRAM"), F.greatest("a.PROGRAM", "b.PROGRAM")),
        "PROGRAM_DELTA_VRAD": turned * delta, "PROGRAM_PAIR_Z": turned * ratio(delta, error("ERR")),
        "PROGRAM_DELTA_VRAD_FORMAL": turned * formal, "PROGRAM_PAIR_Z_FORMAL": turned * ratio(formal, error("ERR_FORMAL")),
        "TEFF_MEDIAN": mean("TEFF"), "LOGG_MEDIAN": mean("LOGG"), "FEH_MEDIAN": mean("FEH"),
    }
    return both.select(*[made[c].alias(c) for c in PAIR_COLUMNS])
