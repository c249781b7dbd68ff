"""Session settings and the shared folder that intermediate tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: dict[str, str] = {}


def local_session(name: str = "ridgewater", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches. On a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # Generated methods above this size are never compiled by the JVM; smaller units are faster then.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDER:
        _LOCAL_FOLDER[app] = tempfile.mkdtemp(prefix="spark-ridgewater-")
    return _LOCAL_FOLDER[app]


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _app_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/ridgewater/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Delete every table this application has staged; results that still read them must be saved first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def without_inferred_filters(spark: SparkSession) -> Iterator[None]:
    """Plans made inside infer no filters from others, which takes the driver seconds for wide rows of CASE columns.

    Rows that a join cannot match are dropped by the join itself, so results stay the same.
    """
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage, survives the loss of executors, and gives the optimiser real file sizes,
    so a later join is broadcast only where the written table is below the broadcast threshold.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a table written by ``stage`` that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/ridgewater/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
