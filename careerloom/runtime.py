"""Session set-up and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "12g", app: str = "careerloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = 8 if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-careerloom-", dir="/tmp"))
    return sc.getCheckpointDir()


@contextmanager
def many_files(spark: SparkSession, opening: int = 64 << 10) -> Iterator[None]:
    """Reads that are run inside take small files by the thousand to a task; Spark counts 4 MB for each, 32 to a task."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(opening))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("tables made", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``cut`` and ``cut_by`` make inside are deleted at the end; those taken out of the list stay."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        discard(*made)


def _made(df: DataFrame, path: str, name: str | None) -> DataFrame:
    df._cut = path, name
    made = _MADE.get()
    if made is not None:
        made.append(df)
    return df


def _forget(df: DataFrame) -> None:
    made = _MADE.get()
    if made is not None and df in made:
        made.remove(df)


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Later uses do not recompute it and do not depend on executors that may be
    lost. Unlike an RDD checkpoint the frame is computed once, and its readers
    prune columns, push filters down and know its size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return _made(spark.read.schema(df.schema).parquet(path), path, None)


def cut_by(
    df: DataFrame, *keys: str, sort: tuple[str, ...] = (), buckets: int | None = None, unique: bool = False, placed: bool = False,
    codec: str = "snappy", onto: DataFrame | None = None,
) -> DataFrame:
    """``cut`` into a table that is bucketed by ``keys`` and, within a bucket, sorted by ``sort`` or else them.

    Joins and groups on the keys read it where it lies, without an exchange on
    its side. Without ``buckets`` their number follows ``buckets_for``.
    ``unique`` keeps one row per key; ``placed`` rows lie by bucket already and are written from where they are.
    With ``onto`` the rows are added to that table, which has the same buckets; its frame does not see them, the new one does.
    """
    spark = df.sparkSession
    n = buckets or buckets_for(df)
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if onto is not None:
        path, name = onto._cut
    rows = df if placed else by_bucket(df, n, *keys)
    rows = _one_per_key(rows, keys) if unique else rows
    writer = rows.write.mode("append").format("parquet").option("path", path).option("compression", codec)
    writer.bucketBy(n, *keys).sortBy(*(sort or keys)).saveAsTable(name)
    if onto is not None:
        _forget(onto)
    return _made(spark.table(name), path, name)


def buckets_for(df: DataFrame, size: int = 64 << 20) -> int:
    """Buckets of about ``size`` bytes as the optimiser expects them, 16 at least and 50,000 at most.

    Where it has no idea (rows that never were a file), as many as the session has shuffle partitions.
    """
    expected = size_of(df)
    if expected >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(50_000, max(16, expected // size))


def by_bucket(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Every bucket of a table to come in one task, however many partitions there are: one file per bucket and write."""
    return df.repartition(2 * buckets, F.pmod(F.hash(*keys), F.lit(buckets)))


def _one_per_key(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first row of every key, where all rows of a key are in one partition: no second exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            yield batch.filter(pa.array([now != before for now, before in zip(found, [last, *found])], pa.bool_()))
            last = found[-1] if found else last

    return rows.sortWithinPartitions(*keys).mapInArrow(run, rows.schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark can write to."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames made by ``cut`` and ``cut_by`` once nobody reads them any more.

    The driver also looks for what it no longer refers to, so that the shuffle
    files of finished stages go as well.
    """
    if not frames:
        return
    spark = frames[0].sparkSession
    for frame in frames:
        path, name = frame._cut
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)
        _forget(frame)
    spark.sparkContext._jvm.System.gc()


def size_of(df: DataFrame) -> int:
    """Bytes that the optimiser expects of a frame; without a way to ask it, too many for any bound."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return 1 << 62


def measured_broadcasts(spark: SparkSession, max_bytes: int = 256 << 10) -> None:
    """Only what is tiny even as files is broadcast unseen; a larger side is run first and broadcast by what it then holds.

    The optimiser takes the bytes of a file for those of its rows, which compressed tables exceed many times over, and
    takes as many rows to leave an explode as went in. The driver has to hold what it broadcasts.
    """
    static, seen = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    jvm = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    now = spark.conf.get(static)
    if jvm.byteStringAsBytes(now) > max_bytes:
        if spark.conf.get(seen, None) is None:
            spark.conf.set(seen, now)
        spark.conf.set(static, str(max_bytes))


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint behind the optimiser's own size estimate.

    Above the bound the frame is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if size_of(df) <= max_bytes else df
