"""Reading tables, and cutting lineage through a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out over all cores where its files come in fewer pieces than there are: a file's row groups can't be split.
    Larger tables have more pieces and stay as they are. The order of rows is lost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def staging_path(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a session on one machine, as in tests, has a folder
    of its own; a cluster has none that its executors share, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back, so that nothing above it is computed twice and
    a lost executor loses nothing of it."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """`df`, joined by a merge of sorted sides: a staged table's files are many times smaller than its rows, so that by their
    size it would be sent through the driver to all tasks."""
    return df.hint("merge")


class Scratch:
    """The staged tables of one run of an operator. Those that its result doesn't read are dropped when it is done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """`df` staged under `name`; a table of that name from an earlier round stays until it is dropped."""
        path = staging_path(self.spark, f"{self.label}-{name}")
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, keep: int = 0) -> None:
        """Empty the tables of these names (default: all), but for the last `keep` of each."""
        for name in names or tuple(self.paths):
            held = self.paths.get(name, [])
            for path in held[: len(held) - keep]:
                self.spark.range(0).write.mode("overwrite").parquet(path)
            self.paths[name] = held[len(held) - keep :]
