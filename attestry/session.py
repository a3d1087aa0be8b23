"""Session defaults, and intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and benches. A cluster brings its own configuration."""
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("attestry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def one_machine(master: str) -> bool:
    """Whether all tasks run in the driver's process."""
    return master == "local" or master.startswith("local[")


def named_folder(master: str, named: str | None) -> str:
    """``named``, or a folder of our own where all tasks run on this machine; elsewhere a folder must be named."""
    if named:
        return named
    if not one_machine(master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="attestry-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, shared by all executors.

    Off local masters a session without it is an error: tables written to a machine's own disk would be read in part.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named_folder(sc.master, sc.getConf().get("spark.checkpoint.dir")))
    return sc.getCheckpointDir()


_written: list[tuple[str, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which ``release`` removes."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext.applicationId, path))
    return path


def shared_checkpoint(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and survives the loss of executors.

    A compressed table rather than a checkpoint of rows: readers take the columns they need and know its size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the tables this application wrote to the shared folder. Call it once its results are consumed."""
    app = spark.sparkContext.applicationId
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for owner, path in [x for x in _written if x[0] == app]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.remove((owner, path))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
