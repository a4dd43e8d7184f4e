"""Session helpers: builder, shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build(app: str = "strata", master: str = "local[8]", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent on a local master (tests, notebooks on one machine) a
    folder of this process is made, set on the session and removed at exit; on a cluster
    an absent setting is an error, for no machine's own folder is shared.
    """
    have = spark.conf.get(CHECKPOINT_KEY, None)
    if have:
        return have.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors of {master} share")
    own = tempfile.mkdtemp(prefix="strata-shared-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set(CHECKPOINT_KEY, f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage with a table in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[got] = path
    return got


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Removes tables that ``written`` made, once nothing reads them any more."""
    for df in frames:
        path = _WRITTEN.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, wherever the driver was started from."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="strata-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "strata_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
