"""Session-level helpers shared by all operators: table access, partition
spreading for Python stages, and lineage cutting through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: the cluster's ``spark.checkpoint.dir``. Only a local
    session that has none (tests, a laptop) gets a temporary folder; elsewhere that is an error."""
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="textloom-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, partitioned: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage. ``partitioned``: the planner goes
    on knowing how the rows are partitioned, so that joins and groupings on the same keys do not
    shuffle them again. (An adaptive plan would lose that, so this one step is planned without, in a
    session of its own.)"""
    spark = df.sparkSession
    shared_folder(spark)
    if not partitioned:
        return df.checkpoint(eager=True)
    plan = lambda session, x: spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, x.queryExecution().logical())
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.adaptive.enabled", "false")
    return DataFrame(plan(spark._jsparkSession, plan(own, df._jdf).checkpoint(True)), spark)


def cut_by(df: DataFrame, *keys: str, within: DataFrame | None = None) -> DataFrame:
    """``cut``, partitioned by the keys. Only rows with keys of ``within`` are kept, if given."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, *keys)
    if within is not None:
        df = df.join(within.repartition(n, *keys), list(keys), "left_semi")
    return cut(df, partitioned=True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan yields fewer partitions than there are cores.

    Large inputs already come in many splits and pass through unchanged, so the
    extra shuffle exists for small files only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def blank_to_null(c):
    """Null for null, empty and white-space-only strings, else the string."""
    return F.when(c.rlike(r"[^\s\p{Z}\x00-\x1f\x7f-\x9f]"), c)


def has_field(df: DataFrame, name: str, kind: DataType | None = None) -> bool:
    """Whether ``df`` has a column of that name (and type)."""
    return name in df.columns and (kind is None or df.schema[name].dataType == kind)
