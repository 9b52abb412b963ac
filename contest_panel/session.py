"""Session settings shared by tests, the benchmark and local runs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "contest-panel") -> SparkSession:
    """A local session; on a cluster use the session the cluster hands out."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Test tables are small: keep every core busy instead of merging to one-megabyte partitions.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a session with local threads may leave it unset (tests, the benchmark): it gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="contest-panel-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each context, wherever the driver was started.

    The bundle is made in the driver's temporary folder; Spark's file server sends it on.
    """
    context = spark.sparkContext
    if getattr(context, "_contest_panel_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="contest-panel-")) / "contest_panel_bundle.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as files:
        for source in sorted(root.glob("contest_panel/**/*.py")):
            files.write(source, source.relative_to(root))
    context.addPyFile(str(bundle))
    context._contest_panel_shipped = True


def materialise(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint (an action): later branches read files, not recomputed lineage."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet in the checkpoint folder and read back (an action).

    For iterations: unlike a checkpoint the table has true sizes and brings along no constraints of the plan behind it.
    """
    path = f"{checkpoint_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Number of partitions the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_count_up_to(frame: DataFrame, limit: int) -> int:
    """Rows of ``frame``, counted no further than ``limit + 1`` (an action)."""
    return frame.limit(limit + 1).count()
