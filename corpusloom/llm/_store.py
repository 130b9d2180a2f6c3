"""Where intermediate tables go, and bounded samples of labelled rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; texts are cut into smaller pieces there.
ARROW_ROWS = 200


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is named and Spark is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Folders of tables written inside of ``collected``.
_collected: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of the tables written inside, so that they can be deleted once nothing reads them."""
    found: list[str] = []
    _collected.append(found)
    try:
        yield found
    finally:
        _collected[:] = [x for x in _collected if x is not found]  # equal lists are others'


def delete_unread(spark: SparkSession, folders: list[str], reader: DataFrame) -> None:
    """Delete folders of the shared folder, but for those that ``reader`` still reads."""
    files = reader.inputFiles()
    shared = shared_dir(spark).removeprefix("file://")
    for folder in folders:
        name = folder.rsplit("/", 1)[-1]
        if folder.removeprefix("file://").startswith(f"{shared}/") and not any(f"/{name}/" in f for f in files):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so later readers neither recompute nor depend on executors."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for found in _collected:
        found.append(at)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep the Arrow batches of text small, so that Python workers stay within their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for the actions inside; what was set before holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows at most, the same ones in every run: those whose hashed key is below a threshold.

    All rows are taken when there are no more than ``bound``. The expected size is ``bound`` beyond
    that, whatever the size of ``df``.
    """
    n = df.count()
    if n <= bound:
        return df
    slots = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(slots)) < int(slots * bound / n))
