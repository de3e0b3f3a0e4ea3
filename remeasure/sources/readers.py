"""Measurement and correction tables from CSV, Parquet and FITS files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remeasure.operators import correction, schema
from remeasure.sources import fits


def _raw(spark: SparkSession, path: str, strict: bool, max_rows: int | None) -> DataFrame:
    low = path.lower()
    if low.endswith((".csv", ".csv.gz")):
        # as text: values are read by the rules of this library, not by guesses
        df = spark.read.csv(path, header=True)
    elif low.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif low.endswith((".fits", ".fits.gz")):
        fits.register(spark)
        reader = spark.read.format("fits_table").option("path", path).option("strict", str(strict).lower())
        return (reader.option("maxRows", str(max_rows)) if max_rows is not None else reader).load()
    else:
        raise ValueError(f"Unsupported input format: {path}")
    return df.limit(max_rows) if max_rows is not None else df


def read_epochs(spark: SparkSession, path: str, max_rows: int | None = None, strict: bool = False) -> DataFrame:
    """One file as epochs, with INPUT_FILE; survey and program from a FITS file's name where it lacks them."""
    df = _raw(spark, path, strict, max_rows)
    if path.lower().endswith((".fits", ".fits.gz")):
        df = schema.add_file_context(df, F.lit(path.rsplit("/", 1)[-1]))
    return schema.as_epochs(df).withColumn("INPUT_FILE", F.lit(path))


def read_many(spark: SparkSession, paths: list[str], max_rows: int | None = None, strict: bool = False) -> DataFrame:
    """The union of several files by name; columns that a file lacks are null."""
    if not paths:
        raise ValueError("at least one input is needed")
    parts = [read_epochs(spark, p, max_rows, strict) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_correction(spark: SparkSession, path: str) -> DataFrame:
    """(TARGETID, VRAD_OFFSET), one row for each key; ValueError if offsets conflict."""
    return correction.unique_correction(correction.clean_correction(_raw(spark, path, False, None)))
