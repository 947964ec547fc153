"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = Path(__file__).resolve().parents[1]


def _on_python_path() -> bool:
    return str(ROOT) in (os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless the Python path they inherit has it. Once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_lexweave_shipped", False) or _on_python_path():
        return
    # an upload of the driver; executors fetch it from there
    base = Path(tempfile.mkdtemp(prefix="lexweave-package-")) / "lexweave_package"
    sc.addPyFile(shutil.make_archive(str(base), "zip", ROOT, "lexweave"))
    sc._lexweave_shipped = True


def local_session(app: str = "lexweave", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    if not _on_python_path():
        os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables (a file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_table(sf_dir: str, name: str) -> bool:
    return os.path.exists(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the folder all executors share.

    The folder is the one named by ``spark.checkpoint.dir``. Only where neither that setting nor a
    checkpoint folder exists (a local test session) is a temporary folder of this machine used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            where = tempfile.mkdtemp(prefix="lexweave-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def broadcast_few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which is looked at first; else as it is.

    For what belongs to a few hits: usually some rows, but of no size that could be told beforehand.
    """
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def parallelism(spark: SparkSession) -> int:
    """Partitions for a CPU-bound exchange: follows the session, never the size of a test."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over enough tasks for work that is bound by CPU.

    A table in a few files or row groups would keep most cores idle; its rows are dealt out. Where the scan gives two
    tasks a core or more, as large tables do, nothing is exchanged.
    """
    if df.isStreaming:
        return df
    sc = df.sparkSession.sparkContext
    want = 2 * sc.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
