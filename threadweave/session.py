"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure that reliable checkpoints have a shared folder and return it.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a temporary folder; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    master = sc.master or ""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def file_system(path: str):
    """(pyarrow's file system, the path in it) of a folder that executors share."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    plain = path.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + plain.lstrip("/") if plain.startswith("/") else plain


@contextmanager
def setting(spark: SparkSession, name: str, value) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this file system import the package from where the driver has it, and keep
    Arrow batches of texts small: unless the session says otherwise, 2,000 rows instead of Spark's 10,000."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, 2_000)
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory."""
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")
