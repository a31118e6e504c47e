"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}
#: Tables of the block of work that is going on in this thread.
_scope: ContextVar[list[str] | None] = ContextVar("tables", default=None)
_tables: list[str] = []


@atexit.register
def _leave() -> None:
    """Intermediate tables on this machine go with the process; elsewhere ``discard_all`` is the way."""
    for path in _tables:
        shutil.rmtree(path, ignore_errors=True)


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, as a URI: a path without a scheme is on Hadoop's default file system.

    So tables, which Spark writes, and files, which tasks write, are in one place. A
    folder of a local scheme is taken as it is, as it may be mounted on every machine.
    Where it is unset and Spark runs in one process, a folder of our own that goes
    with it; on a cluster that would be on one machine only, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
        # Hadoop writes a local path with one slash, others expect three.
        return re.sub(r"^file:/+", "file:///", whole)
    if not local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="countloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, tag: str, most: int = 0) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a re-run. What a
    plan does not decide alike each time (range partitions) is decided once.
    most: rows of a file, if they are so large that no more should be read at once.
    """
    path = fresh_path(df.sparkSession, tag)
    if local(df.sparkSession) and ("://" not in path or path.startswith("file://")):
        _tables.append(path.removeprefix("file://"))
    if (scope := _scope.get()) is not None:
        scope.append(path)
    (df.write.option("maxRecordsPerFile", most) if most else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._countloom_path = path
    return out


def together(*steps: Callable[[], object]) -> list:
    """What the steps give, run side by side: Spark fills the gaps that one small job leaves with another's tasks."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, s) for s in steps]]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``materialise`` gave, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "_countloom_path", None)
        if path:
            own = _written.get(t.sparkSession.sparkContext.applicationId, [])
            if path in own:
                own.remove(path)
            _delete(t.sparkSession, [path])


def _forget(spark: SparkSession, paths: list[str]) -> None:
    own = _written.get(spark.sparkContext.applicationId, [])
    own[:] = [p for p in own if p not in paths]
    _delete(spark, paths)


@contextmanager
def scoped_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside go when the block ends, well or not. For work whose result is written elsewhere."""
    token = _scope.set([])
    try:
        yield
    finally:
        made = _scope.get()
        _scope.reset(token)
        _forget(spark, made)


def drop_unread(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives; of the tables that ``materialise`` wrote meanwhile, those that its plan does not read go."""
    token = _scope.set([])
    try:
        result = build()
        made = _scope.get()
    finally:
        _scope.reset(token)
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in result.inputFiles()}
    _forget(spark, [p for p in made if p.rsplit("/", 1)[1] not in read])
    return result


def discard_all(spark: SparkSession) -> None:
    """Deletes all that this application has written here; results that are still to be read go with it."""
    _delete(spark, _written.pop(spark.sparkContext.applicationId, []))
