"""Spark session defaults and the shared folder for lineage cuts / side tables."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (a shuffle
# side that turns out small becomes a broadcast), coalesces small partitions and
# splits skewed ones; the session time zone is pinned so dates never shift.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tillcast") -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests use
    ``local[*]`` with a small shuffle partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("TILLCAST_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Only when it is unset on a local
    master (tests, a laptop) is a private folder created and registered, so
    that later checkpoints and side tables land in one place; on a cluster an
    unset folder is an error, since each executor would write its own disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current.rstrip("/")
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
        if conf_dir:
            sc.setCheckpointDir(conf_dir)
            return conf_dir.rstrip("/")
        _require_local(sc.master)
        local = tempfile.mkdtemp(prefix="tillcast-ckpt-")
        sc.setCheckpointDir(local)
        return (sc.getCheckpointDir() or local).rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        _require_local(spark.conf.get("spark.master", ""))
        conf_dir = tempfile.mkdtemp(prefix="tillcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    return conf_dir.rstrip("/")


def _require_local(master: str) -> None:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and read it
    back: the lineage is cut, the data is computed exactly once (an RDD
    checkpoint would run the plan a second time to write it), the copy is
    columnar (later reads prune columns and push filters) and the optimizer
    sees its real size. Survives executor loss: the files live in the shared
    folder named by ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_shared(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's file system, wherever the shared folder is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(data)
    finally:
        out.close()


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file in one step: a reader finds the old content or the new one, never a part."""
    made = f"{path}.{uuid.uuid4().hex[:12]}"
    write_shared(spark, made, data)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(source), files.makeQualified(target), overwrite)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the application,
    whatever folder they start in: its sources go to them as a zip, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{scratch_path(spark, os.path.basename(root))}.zip"
    write_shared(spark, path, packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
