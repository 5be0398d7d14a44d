"""Session helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}
#: Steps that materialise() has written and nothing has removed yet, and those of each open settle().
_written: list[str] = []
_recorders: list[list[str]] = []


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that they need no installed copy."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="ledgerloom-ship-")) / "ledgerloom.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        spark.sparkContext.addPyFile(str(out))
        _shipped[app] = str(out)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for steps in (_written, *_recorders):
        steps.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(build: Callable[[], DataFrame], label: str = "step") -> DataFrame:
    """materialise() what build() returns, then remove the steps that were written on the way: nothing reads them any more."""
    steps: list[str] = []
    _recorders.append(steps)
    try:
        df = build()
    finally:
        _recorders.remove(steps)
    out = materialise(df, label)
    remove_steps(df.sparkSession, steps)
    return out


def remove_steps(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete written steps; without paths all of this process, once their results were written elsewhere or read."""
    jvm = spark.sparkContext._jvm
    for path in list(_written if paths is None else paths):
        if path in _written:
            _written.remove(path)
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if not _recorders:
        jvm.System.gc()  # Spark's cleaner drops the shuffle files of plans that the driver no longer holds


#: Times that rows in memory are larger than the files of written steps: sorted ids take a byte or two each there.
FILE_FACTOR = 50.0


def weigh_files(spark: SparkSession) -> SparkSession:
    """Have Spark take tables for as large as their rows are, not their compressed files, before it sends one to all tasks through the driver."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key, "1.0")) < FILE_FACTOR:
        spark.conf.set(key, str(FILE_FACTOR))
    return spark


def materialise_all(frames: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """materialise() of independent frames as concurrent jobs, so that small ones don't wait for each other."""
    if len(frames) < 2:
        return [materialise(*f) for f in frames]
    with ThreadPoolExecutor(min(4, len(frames))) as pool:
        return list(pool.map(lambda f: materialise(*f), frames))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to as many tasks as there are cores where it comes from fewer files than that: for costly work on each row of a few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g", name: str = "ledgerloom") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
