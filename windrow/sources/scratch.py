"""Tables and files that a query writes on its way, and their removal.

They go to the folder that ``spark.checkpoint.dir`` names, which all executors share. A result may
still read them, so they stay until ``clear`` is called or Python ends; where a query fails, and
where ``tidied`` code says so, they go at once.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []


@dataclass(eq=False)  # a scope is itself, not what it holds
class _Left:
    """Folders and catalogue tables, with the session that made them."""

    paths: list[tuple[SparkSession, str]] = field(default_factory=list)
    tables: list[tuple[SparkSession, str]] = field(default_factory=list)

    def remove(self) -> None:
        for spark, name in self.tables:
            with contextlib.suppress(Exception):  # the session may have ended
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        for spark, path in self.paths:
            with contextlib.suppress(Exception):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        self.paths.clear()
        self.tables.clear()


#: What is left for ``clear``, and above it what the running tidied calls have written.
_SCOPES: list[_Left] = [_Left()]


def shared(named: str | None, master: str) -> str:
    """The shared folder that the cluster names. A temporary one only where none is named and
    driver and executors are one process; anywhere else that is an error."""
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="windrow-"))
    return f"file://{_OWN[0].name}"


def work_dir(spark: SparkSession) -> str:
    return f"{shared(spark.conf.get('spark.checkpoint.dir', None), spark.sparkContext.master)}/windrow"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCOPES[-1].paths.append((spark, path))
    return path


def scratch_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new table name and the path of its files."""
    path = scratch(spark, name)
    table = "windrow_" + path.rsplit("/", 1)[1].replace("-", "_")
    _SCOPES[-1].tables.append((spark, table))
    return table, path


def remove(spark: SparkSession, path: str) -> None:
    """Remove one path before its time."""
    for s in _SCOPES:
        if (spark, path) in s.paths:
            s.paths.remove((spark, path))
    _Left([(spark, path)]).remove()


@contextlib.contextmanager
def tidy(keep: bool = True) -> Iterator[None]:
    """What is written inside goes if that fails, or in any case unless ``keep``; catalogue names
    go at the end, their files are kept for readers."""
    here = _Left()
    _SCOPES.append(here)
    try:
        yield
        if keep:
            _SCOPES[-2].paths += here.paths
            here.paths.clear()
    finally:
        _SCOPES.remove(here)
        here.remove()


def tidied(f: Callable) -> Callable:
    @functools.wraps(f)
    def g(*args, **options):
        with tidy():
            return f(*args, **options)

    return g


def clear() -> None:
    """Remove all that queries have left; their results can't be read any more."""
    _SCOPES[0].remove()


atexit.register(clear)
