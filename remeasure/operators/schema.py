"""Names, types and group keys of a measurement table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Other names under which columns are delivered.
ALIASES = {
    "target_id": "TARGETID", "source_id": "SOURCE_ID", "sourceid": "SOURCE_ID", "radial_velocity": "VRAD",
    "radial_velocity_error": "VRAD_ERR", "snr_r": "SN_R",
}
# Columns by type.
INTEGERS = ("TARGETID", "SOURCE_ID", "GROUP_ID", "EXPID", "NIGHT", "FIBER", "TILEID")
NUMBERS = (
    "VRAD", "VRAD_ERR", "VRAD_ADOPTED", "VRAD_ERR_ADOPTED", "VRAD_OFFSET", "SN_R", "SN_B", "SN_Z", "RVS_WARN", "MJD",
    "TEFF", "LOGG", "FEH", "VSINI", "VRAD_SKEW", "VRAD_KURT", "CHISQ_TOT", "CHISQ_C_TOT",
)
TRUE_WORDS = ("true", "1", "yes", "y", "t", "1.0")
REQUIRED = ("TARGETID", "VRAD", "VRAD_ERR")
# Fixed value: how delivered files are named.
_FILE_CONTEXT = r"rvpix_exp-([^-]+)-([^.]+)\.fits(?:\.gz)?$"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Upper-case trimmed names; an alias is taken over unless its target is there already.

    Names that meet after that get _2, _3 and so on, so that none is ambiguous.
    """
    there = {c.strip().upper() for c in df.columns}
    names: list[str] = []
    for c in df.columns:
        target = ALIASES.get(c.strip().lower())
        name = target if target and target not in there else c.strip().upper()
        k, unique = 1, name
        while unique in names:
            k += 1
            unique = f"{name}_{k}"
        names.append(unique)
    return df.toDF(*names)


def validate_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``df`` itself, or a ValueError that names the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"The table has no column {', '.join(missing)}")
    return df


def _integer(c: Column, kind: T.DataType) -> Column:
    """A bigint without a detour over double; '5.0' is 5, '5.5' and text are null."""
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    exact = c.try_cast("decimal(38,6)")
    return F.when(exact == F.floor(exact), F.floor(exact).try_cast("bigint"))


def _number(c: Column) -> Column:
    """A double or null; NaN becomes null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def _truth(c: Column, kind: T.DataType) -> Column:
    """True for true, finite numbers other than 0 and the usual words; never null."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        value = c.cast("double")
        return F.coalesce((value != 0) & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False))
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def coerce_types(df: DataFrame) -> DataFrame:
    """Known columns in their types; what can't be read is null, other columns stay."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    changed = {c: _integer(F.col(c), kinds[c]) for c in INTEGERS if c in kinds}
    changed |= {c: _number(F.col(c)) for c in NUMBERS if c in kinds}
    if "SUCCESS" in kinds:
        changed["SUCCESS"] = _truth(F.col("SUCCESS"), kinds["SUCCESS"])
    return df.withColumns(changed) if changed else df


def add_group_columns(df: DataFrame) -> DataFrame:
    """GROUP_ID and GROUP_KIND: the source where it is above 0, else the negated target (0 for null).

    All rows without source and target share group 0; a negative target gives a positive key,
    which could meet a source.
    """
    target = F.coalesce("TARGETID", F.lit(0))
    if "SOURCE_ID" not in df.columns:
        return df.withColumns({"GROUP_ID": -target, "GROUP_KIND": F.lit("TARGETID_FALLBACK")})
    known = F.coalesce(F.col("SOURCE_ID") > 0, F.lit(False))
    return df.withColumns(
        {"GROUP_ID": F.when(known, F.col("SOURCE_ID")).otherwise(-target), "GROUP_KIND": F.when(known, F.lit("GAIA_SOURCE_ID")).otherwise(F.lit("TARGETID_FALLBACK"))}
    )


def add_file_context(df: DataFrame, file_name: Column) -> DataFrame:
    """SURVEY and PROGRAM from names like rvpix_exp-main-dark.fits, where the columns are missing."""
    missing = [(c, k) for k, c in ((1, "SURVEY"), (2, "PROGRAM")) if c not in df.columns]
    found = {c: F.upper(F.nullif(F.regexp_extract(F.lower(file_name), _FILE_CONTEXT, k), F.lit(""))) for c, k in missing}
    return df.withColumns(found) if found else df


def context_of(path: str) -> tuple[str | None, str | None]:
    """(survey, program) of a file name."""
    match = re.search(_FILE_CONTEXT, path.rsplit("/", 1)[-1].lower())
    return (match[1].upper(), match[2].upper()) if match else (None, None)


def as_epochs(df: DataFrame) -> DataFrame:
    """A delivered table as epochs: named, validated, typed and grouped."""
    return add_group_columns(coerce_types(validate_columns(normalize_columns(df))))
