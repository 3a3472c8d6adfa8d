"""Session helpers: shared folder for cut lineage, and a local session for tests."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cloudstrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Folders of our own by application, where spark.checkpoint.dir is unset; it can't be set once a session runs.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _own_folders.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/cloudstrata-{uuid.uuid4().hex}")
    return where.rstrip("/")


#: Folders made within each open `scratch`, the innermost last.
_scratch: list[list[str]] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path that nothing has written to yet, in the shared folder."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    for made in _scratch[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Owns the intermediate folders made within, and removes them at its end: results are lazy, so write them or collect them before."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.remove(made)
        for path in made:
            drop_folder(spark, path)


#: Spark's setting that removes the shuffle files of a query at its end.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, kind: str, **options) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and a lost executor costs nothing. The shuffles of the write are of no more use, so their files go at its end."""
    path, conf = new_folder(df.sparkSession, kind), df.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of ours through Hadoop's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
