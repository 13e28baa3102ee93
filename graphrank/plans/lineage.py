"""Cutting lineage and fixing results that several later plans read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a statement deletes its shuffle files when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where nothing is configured and the session runs on a local master, tables go to a
    folder inside the session's warehouse. There is no temporary folder of a machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_work")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shuffles_freed(spark: SparkSession):
    """What is written inside leaves no shuffle files: else they stay until the driver happens to collect garbage."""
    return _setting(spark, _FREE_SHUFFLES, "true")


def planned_once(spark: SparkSession):
    """Plans of rounds that fix all their partitions themselves: planning again after every stage only takes time."""
    return _setting(spark, "spark.sql.adaptive.enabled", "false")


def _store(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Workspace:
    """Owner of the tables that are stored while it is open; they are removed when it closes.

    Use it around a job whose result is written, or handed on, before the end::

        with Workspace(spark) as work:
            result = work.hand_on(job(...))   # stored for whoever opened a workspace around this one
    """

    _open: list[Workspace] = []

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._paths = spark, []

    def __enter__(self) -> Workspace:
        Workspace._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Workspace._open.remove(self)
        for path in self._paths:
            _remove(self._spark, path)

    def hand_on(self, df: DataFrame) -> DataFrame:
        """Store ``df``; the table outlives this workspace and belongs to the one around it."""
        stored, path = _store(df)
        place = Workspace._open.index(self)
        if place:
            Workspace._open[place - 1]._paths.append(path)
        return stored


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Compute ``df`` once, store it in the shared folder and return a plan that reads the stored rows.

    ``options`` are those of the Parquet writer.

    Used where two later plans must see exactly the same rows (positions,
    samples) and to cut the lineage of loops. A written table survives the loss
    of executors, later plans read only the columns they need, and its known
    size lets small sides be broadcast. An open ``Workspace`` owns it; without one it stays in the work folder.
    """
    stored, path = _store(df, **options)
    if Workspace._open:
        Workspace._open[-1]._paths.append(path)
    return stored


class Rounds:
    """Stored tables of a loop: a new round replaces the one it was computed from.

    Only the latest round is kept on disk, and the one that ``keep`` was called for last, so a loop needs the space of two
    (of three with a kept one). Whoever holds the table of an earlier round must not read it any more.
    """

    def __init__(self) -> None:
        self._path: str | None = None
        self._kept: str | None = None
        self._spark: SparkSession | None = None

    def store(self, df: DataFrame) -> DataFrame:
        stored, path = _store(df)
        self._spark = df.sparkSession
        if self._path is not None and self._path != self._kept:
            _remove(self._spark, self._path)
        self._path = path
        return stored

    def keep(self) -> None:
        """The latest round stays, one kept before goes."""
        if self._kept not in (None, self._path):
            _remove(self._spark, self._kept)
        self._kept = self._path

    def clear(self) -> None:
        """No round is read any more."""
        for path in {self._path, self._kept} - {None}:
            _remove(self._spark, path)
        self._path = self._kept = None


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
