"""Session building, table access and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_tables: set[str] = set()


def build_session(app: str = "lexflume", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on, UTC time and Arrow transfer; the master is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of our own only in local mode where none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lexflume-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Cut the lineage: write `df` once as Parquet into the shared folder and read it back.

    The files survive lost executors and are removed when the process ends (or by `discard` or `release`). With `by` the
    rows are laid out in so many buckets of that column: joins on it and groupings by it then move none of them.
    """
    spark = df.sparkSession
    name = f"lexflume_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if by and buckets:
        df.repartition(buckets, by).write.format("parquet").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
        _written.append((spark, path))
        _tables.add(path)
        back = spark.table(name)
        back._written_at = path
        return back
    df.write.parquet(path)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def _delete(session: SparkSession, path: str) -> None:
    try:
        if path in _tables:
            _tables.discard(path)
            session.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[-1]}")
        target = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, removed at the end like written tables."""
    path = f"{shared_folder(spark)}/lexflume_{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def release(*frames: DataFrame) -> None:
    """Remove the tables behind frames that `materialize` returned, once nothing reads them any more; others are left alone."""
    for frame in frames:
        path = getattr(frame, "_written_at", None)
        for session, written in _written[:]:
            if written == path:
                _written.remove((session, written))
                _delete(session, written)


def discard(spark: SparkSession | None = None) -> None:
    """Remove the tables that `materialize` has written so far; frames built on them can't be read afterwards."""
    for session, path in _written[:]:
        if spark is None or session is spark:
            _written.remove((session, path))
            _delete(session, path)


atexit.register(discard)


def maybe_broadcast(df: DataFrame, limit: int = 500_000) -> DataFrame:
    """Hint a broadcast if the (materialized) frame of a few narrow columns has at most `limit` rows, else leave a shuffle join."""
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


HEAVY_PARTS = 10_000


def join_by_weight(rows: DataFrame, stats: DataFrame, key: str, weight: str) -> DataFrame:
    """`rows` joined with `stats` (materialized, one row a key; `weight` says how many of the rows have the key).

    All of `stats` is sent to the tasks if it is small. Else only the keys with more than one part in HEAVY_PARTS of the
    weight are, which are fewer than HEAVY_PARTS whatever the input, and the rest meet their rows in a shuffle by key,
    where no key is heavy.
    """
    small = maybe_broadcast(stats)
    if small is not stats:
        return rows.join(small, key)
    total = stats.agg(F.sum(weight)).first()[0] or 0
    heavy = stats.where(F.col(weight) > total / HEAVY_PARTS)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(stats.where(F.col(weight) <= total / HEAVY_PARTS), key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)
