"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows that one file of an intermediate table holds.
ROWS_PER_FILE = 1 << 18
#: Fewer are not worth another task.
ROWS_PER_TASK = 1 << 13

#: Rows of a narrow table that one task turns into pages and mines; fewer than the second are not worth another task.
PAGES_PER_TASK, LEAST_PAGES = 1 << 14, 1 << 9

#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, by Spark's reader alone; workers get this package with it."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """The rows of a narrow table dealt by its key, so that costly work on them is shared by all cores.

    A table that is small on disk comes in one or few pieces, whatever the number of its rows. They are counted (of a
    Parquet table by its footers): each task gets at most some 16,000, and there are two tasks a core if the rows suffice.
    """
    rows = table.count()
    few = min(2 * table.sparkSession.sparkContext.defaultParallelism, -(-rows // LEAST_PAGES))
    return table.repartition(max(1, few, -(-rows // PAGES_PER_TASK)), key)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per context.

    Python workers then import it whatever their working folder is.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pagelathe_shipped", False):
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE_DIR):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("pagelathe", os.path.relpath(full, _PACKAGE_DIR)))
    path = os.path.join(tempfile.mkdtemp(prefix="pagelathe-"), "pagelathe.zip")
    with open(path, "wb") as out:
        out.write(blob.getvalue())
    sc.addPyFile(path)
    sc._pagelathe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir; only where that is unset and all runs in one process (tests, one machine)
    a local one is made. On a cluster an unset folder is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagelathe-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts the lineage and freezes generated ids; the files outlive lost executors. `rows` is a bound of the
    number of its (narrow) rows, where one is known: few rows then go to few files instead of a tiny file
    for every shuffle partition, a task for each core if there are rows enough. What the write shuffled is deleted
    when it has ended, as nothing reads it again.
    """
    spark = df.sparkSession
    if rows is not None:
        cores = min(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
        df = df.coalesce(max(1, cores, -(-rows // ROWS_PER_FILE)))
    path = f"{shared_dir(spark)}/pagelathe/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagelathe_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` has written and that nothing reads any more."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._pagelathe_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, or `base` with underscores in front until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
