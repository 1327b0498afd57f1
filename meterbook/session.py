"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import hashlib
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leave every sizing decision alone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Workers then import it whatever folder the driver was started in.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parent
    files = sorted(f for f in package.rglob("*.py"))
    digest = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    folder = tempfile.mkdtemp(prefix="meterbook-ship-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/{package.name}-{digest}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in files:
            out.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``; without it only a local
    master may go on, with a fresh folder that goes when the process ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        current = tempfile.mkdtemp(prefix="meterbook-checkpoint-")
        atexit.register(shutil.rmtree, current, True)
        sc.setCheckpointDir(current)
    return current


#: Spark's setting by which a query's shuffle files go when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder, and read back.

    For a table several branches of one job read: they then share one
    computation, read only the columns they need, and a lost executor costs a
    re-read rather than the whole lineage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/meterbook-stage/{uuid.uuid4().hex}"
    # Nothing reads the write's shuffle files again; left to the driver's garbage collection they add up.
    held = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if held is None else spark.conf.set(DROP_SHUFFLES, held)
    return spark.read.schema(df.schema).parquet(path)


#: What opening a file counts as, in bytes, where there are many small ones.
OPEN_BYTES = 65_536


def many_files(spark: SparkSession) -> SparkSession:
    """A copy of the session that reads folders of many small files.

    Spark counts a file as 4 MB at least, so a task would get a handful, and lists every
    folder by a task of its own. The caller's settings stay as they are; give what is
    read back to the caller's session (``handed``).
    """
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, most in (
        ("spark.sql.files.openCostInBytes", OPEN_BYTES),
        ("spark.sql.sources.parallelPartitionDiscovery.parallelism", 8 * spark.sparkContext.defaultParallelism),
    ):
        held = int(str(copy._jsparkSession.sessionState().conf().getConfString(key)).removesuffix("b"))
        copy.conf.set(key, min(held, most))
    return copy


def handed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of another session's reader, in this session."""
    of = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    return DataFrame(of(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a table comes in fewer splits than half of them.

    A table of one row group is read by one task; what follows need not be. Large
    tables have splits enough and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def local_session(app: str = "meterbook", cores: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("METERBOOK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
