"""Session helpers."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", app: str = "tickloom", **conf: str) -> SparkSession:
    """A session for tests and the bench. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs more than building these plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of all executors."""
    sc = spark.sparkContext
    if getattr(sc, "_tickloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tickloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._tickloom_shipped = True


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections do not recompute.

    A plain projection would be merged into every filter and field access above
    it; the output of a generator is not.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; only a local session
    without one gets a temporary folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
