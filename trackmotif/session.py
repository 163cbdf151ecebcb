"""Session helpers: shipping this package to workers, and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches are held to 8 MB unless the session asks for another size than Spark's own.
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
PACKAGE = os.path.dirname(os.path.abspath(__file__))


def build_session(app: str = "trackmotif", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make ``trackmotif`` importable in Python workers: a zip of the sources goes to every executor, once per context."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(8 << 20))
    context = spark.sparkContext
    if getattr(context, "_trackmotif_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="trackmotif-"), "trackmotif_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("trackmotif", os.path.relpath(full, PACKAGE)))
    context.addPyFile(path)
    context._trackmotif_shipped = True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all nodes see. Where that is unset, a session of one machine
    gets a temporary folder, and any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_trackmotif_scratch", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes see")
            base = "file://" + tempfile.mkdtemp(prefix="trackmotif-shared-")
            spark.sparkContext._trackmotif_scratch = base
    return f"{base.rstrip('/')}/trackmotif/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession) -> list[str]:
    """Tables that ``materialise`` has written in this session and that are still there."""
    if not hasattr(spark.sparkContext, "_trackmotif_tables"):
        spark.sparkContext._trackmotif_tables = []
    return spark.sparkContext._trackmotif_tables


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage is cut, a lost executor loses nothing.

    The table stays until ``drop_tables``.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Remove what ``materialise`` has written, from the ``since``-th table to before the ``until``-th (counted as slices are).

    For when what was derived from the tables is written itself: nothing that reads them can run again.
    """
    tables = _written(spark)
    for path in tables[since:until]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del tables[since:until]


def tables_written(spark: SparkSession) -> int:
    return len(_written(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
