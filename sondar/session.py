"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast


def get_session(app: str = "sondar", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session, whose executors share the driver's disk, gets one of
    its own where none is set; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    held = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if held:
        return held
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="sondar-checkpoint-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return _LOCAL[context.applicationId]


#: Folders of local sessions that set none.
_LOCAL: dict[str, str] = {}


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df written as a compressed table in the shared folder, in folders of the columns `by`, and read again: cuts lineage,
    survives lost executors, and lets every reader prune its columns and folders. Removed at exit."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sondar-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    cleared(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver exits."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Most bytes of a side that is broadcast after its rows were counted.
BROADCAST_BYTES = 32_000_000


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df marked for broadcast if its counted rows fit in BROADCAST_BYTES; else as it is, for a shuffled join."""
    most = BROADCAST_BYTES // row_bytes
    return broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes of a shuffle for each partition that it starts with; AQE joins partitions up to its advisory size.
PARTITION_BYTES = 16_000_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in folders]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)


@contextlib.contextmanager
def shuffling(spark: SparkSession, size: int):  # noqa: ANN201
    """While actions run here, shuffles start with partitions enough for `size` bytes, so that a task's share doesn't grow
    with the data; never with fewer than the session asks for."""
    held = spark.conf.get(_INITIAL, None)
    least = int(held or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(_INITIAL, str(max(least, -(-size // PARTITION_BYTES))))
    try:
        yield
    finally:
        spark.conf.set(_INITIAL, held) if held else spark.conf.unset(_INITIAL)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that they find it
    wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sondar-")) / "sondar.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as held:
        for file in sorted(root.rglob("*.py")):
            held.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """n rows of df, those of the smallest hashes of their ids. Rows are counted first, so that a threshold on the
    hash leaves hardly more than n of them before they are ordered, however many partitions there are."""
    total = df.count()
    rank = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    if total > n:
        df = df.where(rank < int((1 << 40) * min(1.0, (1.2 * n + 100) / total)))
    return df.orderBy(rank, id_col).limit(n)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for a Python stage over a table of fewer file splits than cores. Tables with
    enough splits (all large ones) are left as they are. Only for narrow plans over a scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
