"""Shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="faultlens-"))
    return context.getCheckpointDir()

T = TypeVar("T")


class Scratch:
    """Copies that one owner has written to the shared folder, until its last user closes it.

    Owners are independent: closing one never touches what another has written, in
    whatever order and session. A path counts as the owner's before anything
    is written to it, so failed writes are deleted as well.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.users = 1
        self.paths: list[str] = []
        # What has been written under a name, see written_once.
        self.key: object = None
        self.value: object = None
        _OWNERS.setdefault(_session_key(spark), []).append(self)

    def new_path(self, name: str) -> str:
        """A path below the shared folder that nothing uses yet."""
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return path

    def share(self) -> Scratch:
        """One more user, who closes it too."""
        self.users += 1
        return self

    def close(self) -> None:
        """One user less; with the last one the copies go. Further calls do nothing."""
        self.users -= 1
        if self.users <= 0:
            self.delete()

    def delete(self) -> None:
        """Delete the copies whoever still uses them."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[-1])
            path.getFileSystem(conf).delete(path, True)
            self.paths.pop()
        own = _OWNERS.get(_session_key(self.spark), [])
        if self in own:
            own.remove(self)

    @contextmanager
    def collecting(self) -> Iterator[Scratch]:
        """Inside, what :func:`pin` writes is this owner's; an error deletes it all."""
        before = _CURRENT.set(self)
        try:
            yield self
        except BaseException:
            self.delete()
            raise
        finally:
            _CURRENT.reset(before)


# Owners with copies, by session, and the one that copies made now belong to.
_OWNERS: dict[str, list[Scratch]] = {}
_CURRENT: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def _session_key(spark: SparkSession) -> str:
    return f"{spark.sparkContext.applicationId} {spark._jsparkSession.sessionUUID()}"


def _owner(spark: SparkSession) -> Scratch:
    """The owner of the moment, or one that lasts until :func:`release`."""
    current = _CURRENT.get()
    if current is not None and _session_key(current.spark) == _session_key(spark):
        return current
    own = _OWNERS.get(_session_key(spark), [])
    return next((one for one in own if one.users == 0 and one.key is None), None) or _unowned(spark)


def _unowned(spark: SparkSession) -> Scratch:
    one = Scratch(spark)
    one.users = 0
    return one


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet; it goes with its owner."""
    return _owner(spark).new_path(name)


def written_once(spark: SparkSession, key: object, write: Callable[[], T]) -> T:
    """What ``write`` gave when it was first called for this key in the session.

    For inputs that several queries read: what it writes stays until :func:`release`,
    after which it is written again.
    """
    for owner in _OWNERS.get(_session_key(spark), []):
        if owner.key == key:
            return owner.value
    with Scratch(spark).collecting() as owner:
        value = write()
        owner.key, owner.value = key, value
    return value


def pin(df: DataFrame, compact: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there afterwards.

    Used where several later steps read the same rows: they see the same line
    positions, the input is not scanned again, and losing executors loses nothing.
    The copy is parquet, so readers take only the columns they need. It stays until
    its owner is closed: the :class:`Scratch` that collects at the time, or else the
    session, see :func:`release`. ``compact`` is for the few rows a filter leaves: they are
    gathered into files of the advised partition size, however many splits were read.
    """
    spark = df.sparkSession
    if compact:
        df = df.hint("rebalance")
    path = new_shared_path(spark, "pin")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all copies that this session has written, those of open reports included."""
    for owner in list(_OWNERS.get(_session_key(spark), [])):
        owner.delete()


def pinned(spark: SparkSession) -> int:
    """How many copies this session keeps."""
    return sum(len(owner.paths) for owner in _OWNERS.get(_session_key(spark), []))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters read instead of repeating its expression.

    Filters are pushed through plain projections, each mention of the column
    replaced by its expression. They are not pushed through a generator, here
    one that gives a single row.
    """
    return df.withColumn(name, value).withColumn(name, F.explode(F.array(name)))
