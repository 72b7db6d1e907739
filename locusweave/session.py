"""Session helpers: table access, reliable checkpoints, and a local session for tests and the bench."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settled tables that are still there, and the session that wrote each.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Where neither that setting nor an earlier call
    gave one, a session in one process (tests on one machine) takes a fresh local folder; any other
    raises an error, since its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written copy.

    Used where a loop would otherwise grow its lineage or where a costly intermediate is read more
    than once. The copy survives the loss of executors, and its files tell the optimizer its true
    size. It is removed by :func:`release` or when the program ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    if not _written:
        atexit.register(_release_all)
    _written[path] = spark
    return out


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that sort both sides and never broadcast one.

    For sides that grow with the data: the optimizer takes the size of a settled table from its
    compressed files, and that of its exploded arrays from there, many times too low. It would
    gather such a side in the driver.
    """
    return df.hint("merge")


def release(df: DataFrame) -> None:
    """Remove the files behind a settled table that nothing reads any more."""
    path = getattr(df, "_settled", None)
    if path in _written:
        _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def _release_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001, S110 - the session may be gone already
            pass
    _written.clear()


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("locusweave")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
