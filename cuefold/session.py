"""Session helpers shared by every operator: table access, lineage cuts, sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package known to the Python workers, wherever they run; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_cuefold_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cuefold-")) / "cuefold.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._cuefold_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    missing setting is an error, as executors share no temporary folder.  The local folder
    is removed at exit; in a shared one Spark removes what is no longer referred to if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="cuefold-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its source has fewer partitions than there are cores.

    For work that costs much more than moving its input: a small file is one partition
    else.  Inputs of any size have partitions enough and stay as they are, and so do inputs
    that are shuffled anyway, which asking for partitions would run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def millis(seconds: str) -> F.Column:
    """Whole milliseconds of a column of seconds (null stays null, NaN becomes null)."""
    c = F.col(seconds)
    return F.when(~F.isnan(c), F.round(c * 1000).cast("long"))
