"""Session helpers: reading the test tables and cutting lineage in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What ``stored`` has written and ``drop_stored`` not yet removed, by application.
_PATHS: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the context's checkpoint directory.

    A cluster names it in ``spark.checkpoint.dir``; without it a RuntimeError is raised there, as no
    folder of one machine is seen by the others. Where the master is local and neither the setting
    nor an earlier ``setCheckpointDir`` exists (tests, a laptop), a temporary folder is set.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("Name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="remeasure-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: later jobs read files that outlive any executor, and nothing upstream
    runs twice. Columns and rows are unchanged; row order isn't kept. ``drop_stored`` removes the
    files when nothing that reads them is needed any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Removes what ``stored`` has written in this application; the number of tables removed.

    To be called when the results of earlier queries have been written or collected: a DataFrame
    that is made from a stored table can't be read afterwards.
    """
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
