"""Session factory and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "trajecta", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores or os.cpu_count()}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRAJECTA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Only where a session on one machine sets no folder (tests) a local one is made. The files are
    shared storage, so losing an executor loses nothing.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session on one machine without it gets a temporary one, a cluster an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="trajecta-ckpt-")


def parallelism(spark: SparkSession) -> int:
    """Partitions for a Python stage: enough for every core, and as many as the shuffle setting asks for."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each context, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_trajecta_shipped", None) is None:
        here = Path(__file__).parent
        file = Path(tempfile.mkdtemp(prefix="trajecta-code-")) / "trajecta.zip"
        with zipfile.ZipFile(file, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(file))
        sc._trajecta_shipped = str(file)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for stages that cost more than moving their input.

    A large scan has more splits than that and stays as it is; only a few small files are dealt out. What already went
    through an exchange stays too: counting its partitions would run it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
