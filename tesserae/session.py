"""Session helpers shared by every module: the shared folder, written tables, shipping the package."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether tasks run on the driver's machine, in its own process's folder."""
    return bool(re.match(r"local(\[|$)", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, and any other is refused."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
    return given.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by release() or when the driver ends."""
    path = f"{shared_dir(spark)}/tesserae/{name}-{uuid.uuid4().hex}"
    atexit.unregister(release)
    atexit.register(release)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Remove all tables written so far. Call it when the results that read them are stored; the driver's end does it too."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # that session has ended; the cluster's own cleaning takes the folder
            continue


def ship(spark: SparkSession) -> None:
    """Let executors import this package: a local session has it on its path, any other gets it as an archive."""
    app = spark.sparkContext.applicationId
    on_path = is_local(spark) and (ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == ROOT)
    if on_path or app in _shipped:
        return
    _shipped.add(app)
    at = os.path.join(tempfile.mkdtemp(prefix="tesserae-"), "tesserae.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "tesserae")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
